"""Sentence boundaries across languages and scripts, learned from the corpus itself.

One pass reads every text: it finds its units and the places in them that may be
boundaries, with the word before and the key of what follows, and counts words.
It looks at many texts together, at each distinct word once; a segment whose words
do not tell its places by themselves (scripts without blanks, nested or unclosed
quotations) is gone through mark by mark.
The places are kept as a table in the shared folder; all that follows is SQL on it.

Three statistics are learned per language, each kept where a log-likelihood ratio
(Dunning's, twice the logarithm of the likelihoods of two hypotheses) says that it
is more than chance:

* starters: a key is met at certain starts (of a line of prose or of a numbered
  step, behind a question) against everywhere else. A number counts with the two
  words behind it, so "20 V must" can be one; scripts without blanks between
  words count the first characters;
* abbreviations: the stops behind a word are followed by starters and line's ends
  against by others. Where that says nothing, the word's occurrences with a stop
  are weighed against those without, as a rate of .99 against the language's, with
  a factor for its length and for stops inside;
* collocations: a number, letter or abbreviation before a stop and a key behind it
  that is no starter meet more often than their counts would make them: they belong
  together.

A place is a boundary if the starter's log odds and the abbreviation's, less the
collocation's, come out above 0. Other terminal marks have a fixed prior in place
of the abbreviation's, a blank in scripts without full stops has none. A quotation
or bracket ends a sentence only if it closes behind a terminal mark and a starter
follows. What a language has no evidence of is looked up in all languages together.

Verdicts are given once a distinct case (mark, word, key) and joined to the places,
so nothing learned is collected, and no entry is left out, however many there are.
"""

from __future__ import annotations

import gc
import re
from collections import Counter
from hashlib import blake2b
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomwright.session import written

#: Fewest counts of an entry.
LEAST = 2
#: Keys a task keeps of words it has met; only memory depends on it.
KEEP_KEYS = 400_000
#: Counts a task gathers before it hands them on; only memory depends on it.
FLUSH = 400_000
#: Bytes of text a task looks at together; only memory depends on it.
TOGETHER = 4_000_000
#: Longest word that is its own key; of longer ones the first part and a digest are.
LONGEST = 48
#: Widths between which lines of prose may be wrapped.
NARROWEST_WRAP, WIDEST_WRAP = 40, 100
#: Characters a wrapped line may fall short of the width, as texts are edited after they are wrapped; more where the next goes on in lower case.
SLACK, SLACK_LOWER = 2, 14
#: What a word's place behind a full stop counts against its being a starter, beside places within sentences.
BEHIND_STOP = 0.1
#: Log-likelihood ratios from which an entry says something: starters and stops by their places, abbreviations by their rates, collocations.
SURE, SURE_ABBREVIATION, SURE_COLLOCATION = 1.0, 0.3, 7.88
# Log odds of a boundary at marks other than the full stop.
PRIOR = {"!": 4.0, "?": 4.0, "؟": 4.0, "।": 4.0, "॥": 4.0, "。": 9.0, "！": 9.0, "？": 9.0, "…": -2.0, ";": 3.0, ")": -0.5, " ": 0.0, "^": -0.5}
#: Log odds of words never met: lower case, number, other; of a stop behind a word never met, behind an abbreviation by rates, and what a collocation takes away.
UNMET, UNMET_STOP, ABBREVIATED, COLLOCATED = (-3.0, -1.5, 0.4), 1.5, -1.0, 2.0

LINE = re.compile("[^\r\n\x0b\x0c\x85\u2028\u2029]+")
ODD = re.compile(r"[-–—•▪‣◦*·#|\t→>⇒➔+]")
BULLET = re.compile(r"\s*[-–—•▪‣◦*·]\s+")
HASH = re.compile(r"\s*#{1,6}\s+")
STEP = re.compile(r"\s*(?:(?:step|schritt|étape|paso|шаг)\s+\d+\s*[:.)]|\(?(?:\d{1,4}|[a-z])[.)](?=\s)|\d{1,4}、|\((?:\d+|[a-z])\)|\d+(?:\.\d+)+\.?(?=\s))\s*", re.I)
#: First letters of the words that may stand before a step's number.
STEP_LETTERS = "sSéÉpPшШ"
ROW = re.compile(r"\s\|(?:\s|$)|\t\S[^\t]*\t")
CHAIN = re.compile(r"\s(?:→|->|=>|⇒|➔|\+)\s")
QUOTES = "[\"“”„«»「」『』《》()（）\\[\\]]"
# A character that may end something, and the run of its like behind it.
MARK = re.compile(r"[.!?…।॥؟;。！？" + QUOTES[1:] + r"(?:(?<=[.!?…।॥؟;])[.!?…।॥؟;]+|(?<=[。！？])[。！？]+)?")
MARK_THAI = re.compile(MARK.pattern + r"|(?<=[฀-๿.\d])\s+(?=\S)")
SIGNS = re.compile(r"(?:[†‡§✓✔☞►▶■□●○☐☑⚠⚡❗❕🔧🔩🛠📌📎💡🚫⛔✅❌\U0001f300-\U0001faff☀-➿]️?[\s​]*)+")
OPENERS = "\"'“„«‘‹「『《(（[¿¡ \xa0"
CLOSERS = {"”": "“„", "“": "„", "»": "«", "」": "「", "』": "『", "》": "《", ")": "(", "）": "（", "]": "[", '"': '"'}
TAIL = "\"'.,;:!?…)]}»”“’」』、。！？।؟،"
THAI, HAN = re.compile(r"[฀-๿຀-໿ក-៿က-႟]"), re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
DENSE = re.compile(r"[\u0e00-\u0eff\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff。！？，、」』”）]")
GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
UNBROKEN, UNSPACED = re.compile(r"[^ \t\r\n]+"), re.compile(r"\S+")
NEXT = re.compile(r"(\S+)(?:\s+(\S+))?(?:\s+(\S+))?")
HEAD = re.compile(r"[\s\u200b]*((?:%s)?[%s]*)(\S+)(?:\s+(\S+))?(?:\s+(\S+))?" % (SIGNS.pattern, re.escape(OPENERS)))
#: What follows a colon, up to three words.
COLON = re.compile(r":[^\S\n]+(?=(\S+)(?:\s+(\S+))?(?:\s+(\S+))?)")
CODE = re.compile(r"\s*([a-z]{2})", re.I)
# Script ranges by language code, in blocks of 128 code points, to see a wrong label.
SCRIPTS = {"zh": ((0x3000 >> 7, 0xA000 >> 7), (0xF900 >> 7, 0xFB00 >> 7)), "ja": ((0x3000 >> 7, 0xA000 >> 7), (0xF900 >> 7, 0xFB00 >> 7)), "th": ((0xE00 >> 7, 0xE80 >> 7),), "el": ((0x380 >> 7, 0x400 >> 7), (0x1F00 >> 7, 0x2000 >> 7)), "hi": ((0x900 >> 7, 0x980 >> 7),), "ar": ((0x600 >> 7, 0x700 >> 7),), "ru": ((0x400 >> 7, 0x500 >> 7),)}

SCRIPT_BLOCKS = np.array([[any(lo <= b < hi for lo, hi in ranges) for b in range(1 << 9)] for ranges in SCRIPTS.values()], dtype=np.int64)


def language(label: str | None, text: str) -> str:
    """The code of a label, "" where it is missing or its script is not the text's; the whole text counts."""
    m = CODE.match(label or "")
    code = m.group(1).lower() if m else ""
    if text.isascii():
        return "" if code in SCRIPTS else code
    # Characters by blocks of 128 code points.
    blocks = np.bincount(np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16) >> 7, minlength=1 << 9)
    for own, n in zip(SCRIPTS, (SCRIPT_BLOCKS @ blocks).tolist()):
        much = n * 4 > len(text)
        if (own == code) != much and (own == code or own not in ("zh", "ja")):
            return own if own != code else ""
    return code


def segments(text: str) -> list[tuple[int, int, int]]:
    """(start, end, start behind a step's number) of the text's lines, wrapped lines of prose joined; -1 for lines that are one unit."""
    lines, steps = [], []
    for m in LINE.finditer(text):
        line = m.group()
        if not line.isspace():
            whole = bool(ODD.search(line) and (BULLET.match(line) or HASH.match(line) or ROW.search(line) or len(CHAIN.findall(line)) >= 2))
            s, e = m.span()
            lines.append((s, e, whole))
            c = line[0]  # most lines begin with a word that is no step's
            steps.append(None if whole or (c.isalpha() and c not in STEP_LETTERS and line[1:2] not in ".)") else STEP.match(text, s, e))
    plain = [not whole and not step for (_, _, whole), step in zip(lines, steps)]
    full = [False] * len(lines)  # whether a line goes on in the next one
    pairs = []
    for i, ((s, e, _), (s2, e2, whole)) in enumerate(pairwise(lines)):
        if whole or not (plain[i] or (i and plain[i - 1])):
            continue
        gap = text[e:s2]
        if gap == "\n" or gap == "\r\n" or gap.count("\n") + gap.count("\r") - gap.count("\r\n") == 1:
            first = UNBROKEN.search(text, s2, e2).group()
            last = text[e - 1]
            pairs.append((i, e - s, first, last, last > "\u0dff" and bool(DENSE.match(last))))
    if not pairs:
        return [(s, e, -1 if whole else step.end() if step and step.end() < e else s) for (s, e, whole), step in zip(lines, steps)]
    # Lines that are wrapped beyond doubt give the width.
    sure = [n for i, n, first, last, dense in pairs if plain[i] and not dense and NARROWEST_WRAP <= n <= WIDEST_WRAP and (first[0].islower() or ((last.isalnum() or last == ",") and (first[0].isdigit() or n > 60)))]
    lower = [n for i, n, first, last, dense in pairs if plain[i] and not dense and first[0].islower() and NARROWEST_WRAP <= n <= WIDEST_WRAP]
    width = max(lower or sure, default=0)
    solid = Counter(n for i, n, first, last, dense in pairs if plain[i] and dense and n >= 24)
    block = max((n for n, times in solid.items() if times >= 3), default=0)
    for i, n, first, last, dense in pairs:
        if not (plain[i] or (i and full[i - 1])):
            continue
        if dense:
            full[i] = bool(block) and block - 1 <= n <= block
        elif width:
            marked = steps[i + 1] is not None and not first[0].isalpha()  # a number behind a line that is full may be a step's
            slack = SLACK_LOWER if first[0].islower() and not marked else 0 if marked else SLACK
            full[i] = width - slack < n + 1 + len(first) and n <= width + SLACK and not (marked and last in "?!؟।")
    out: list[list] = []
    for i, (s, e, whole) in enumerate(lines):
        if i and full[i - 1]:
            out[-1][1] = e
        else:
            out.append([s, e, -1 if whole else steps[i].end() if steps[i] and steps[i].end() < e else s])
    return out


def first_key(text: str, at: int, end: int) -> tuple[int, str]:
    """(start of the unit that begins behind ``at``, key of its first word); the start is -1 if nothing is there."""
    begin = at + 1 if text[at : at + 1] == " " else at
    if begin < end and text[begin].isalnum():
        held = NEXT.match(text, begin, end).groups()  # by far the most frequent case
    else:
        m = HEAD.match(text, at, end)
        if not m:
            while at < end and (text[at].isspace() or text[at] == "\u200b"):
                at += 1
            return (at, "") if at < end else (-1, "")
        held, begin = m.group(2, 3, 4), m.start(1)
    word, after, third = held
    c = word[0]
    if c.isdigit() or c in ".-":
        return begin, word_key(word, after, third)
    return begin, _KEYS[word if c.islower() else (word, after) if after is None or after.isalpha() else held]


class Keys(dict):
    """First word in lower case, or with what follows it -> key."""

    def __missing__(self, held: str | tuple) -> str:
        if len(self) > KEEP_KEYS:
            self.clear()
        key = self[held] = word_key(held, None, None) if held.__class__ is str else word_key(*held, None) if len(held) == 2 else word_key(*held)
        return key


_KEYS = Keys()


def _short(word: str) -> str:
    return word if len(word) <= LONGEST else f"{word[: LONGEST // 2]}~{blake2b(word.encode('utf-8', 'surrogatepass'), digest_size=8).hexdigest()}"


def word_key(word: str, after: str | None, third: str | None) -> str:
    """Key of a first word; behind a tab, for words not in lower case, the longer key with the word or two after it."""
    word, after, third = _short(word), after and _short(after), third and _short(third)
    c = word[0]
    if c.isdigit() or (c in ".-" and len(word) > 1 and word[1].isdigit()):
        if HAN.search(word):
            return "#" + re.sub(r"[\d.,:]+", "", word)[:2]
        return f"# {(after or '').strip(TAIL)} {(third or '').strip(TAIL)}"
    if c > "\u0e00":
        if HAN.match(c):
            return re.sub(r"\d", "0", word[:2])
        if THAI.match(c):
            return word[:4]
    if not after or c.islower():
        longer = ""
    elif any(x.isdigit() for x in after):
        longer = f"{word} # {(third or '').strip(TAIL)}"
    else:
        longer = f"{word} {after.strip(TAIL)}"
    word = word.rstrip(TAIL)
    if any(x.isdigit() for x in word):
        return re.sub(r"\d+", "0", word) if len(word) < 8 else "#0"
    return f"{word or '.'}\t{longer}" if longer else word or "."


def stop_key(text: str, at: int, begin: int) -> str:
    """The word that ends at ``at``, before a full stop."""
    if at == begin or text[at - 1].isspace():
        return "."
    width = 40
    while True:
        low = max(begin, at - width)
        held = text[low:at].rsplit(None, 1)
        word = held[-1]
        if len(held) > 1 or low == begin or len(word) < at - low:
            break
        width *= 4  # a longer word
    return _ended(word)


def _ended(word: str) -> str:
    key = _ENDED.get(word)
    if key is None:
        if len(_ENDED) > KEEP_KEYS:
            _ENDED.clear()
        key = _ENDED[word] = ended(word)
    return key


def ended(word: str) -> str:
    word = word.lstrip("\"'“„«(（[¿¡’‘")
    if not word:
        return "."
    if word[-1].isdigit() or (word[0].isdigit() and len(word) > 3):
        return "#"
    return word[-24:] if word[-1] > "\u0dff" and DENSE.match(word[-1]) else _short(word)  # in scripts without blanks what comes last


def next_key(words: list[str], i: int) -> str:
    """Key of the word at ``i``, which begins with a letter or digit."""
    word = words[i]
    c = word[0]
    if c.islower():
        return _KEYS[word]
    held = words[i + 1 : i + 3]
    after = held[0] if held else None
    third = held[1] if len(held) > 1 else None
    if c.isdigit():
        return word_key(word, after, third)
    return _KEYS[(word, after) if after is None or after.isalpha() else (word, after, third)]


class Marks(dict):
    """Word -> its marks, (start, end, marks) each, without points before digits; where there is but a full stop at its end, the key of what stands before it."""

    def __missing__(self, word: str) -> tuple | str:
        found = tuple((m.start(), m.end(), m.group()) for m in MARK.finditer(word))
        found = tuple(x for x in found if x[2] != "." or not word[x[1] : x[1] + 1].isdigit())
        marks = ended(word[:-1]) if len(found) == 1 and found[0][2] == "." and found[0][1] == len(word) else found
        if len(word) <= LONGEST:
            if len(self) > KEEP_KEYS:
                self.clear()
            self[word] = marks
        return marks


_MARKS = Marks()


def word_starts(text: str, begin: int, end: int, words: list[str]) -> list[int]:
    """Where the words of a segment begin, each less the number of words before it."""
    ends = list(accumulate(map(len, words), initial=begin))
    if ends[-1] + len(words) - 1 == end:  # one blank between any two
        return ends
    return [m.start() - i for i, m in enumerate(UNSPACED.finditer(text, begin, end))]


_ENDED: dict[str, str] = {}


def candidates(text: str, begin: int, end: int, thai: bool = True, words: list[str] | None = None) -> list[tuple[str, str, int, str]]:
    """(mark, word before, start of what follows, key of it) at each place of a segment that may be a boundary.

    The mark is "." for a full stop, ")" for a quotation or bracket closed behind a
    terminal mark, " " for a blank in a script without full stops. ``thai`` may be
    False where the text holds no such script; ``words`` are the segment's, if known.
    """
    thai = thai and bool(THAI.search(text, begin, end))
    if thai:
        marks = [(m.start(), m.end(), m.group(), -1, "") for m in MARK_THAI.finditer(text, begin, end)]
    else:
        if words is None:
            words = text[begin:end].split()
        met = [(i, x) for i, x in enumerate(map(_MARKS.__getitem__, words)) if x]
        if not met:
            return []
        last = len(words) - 1
        if met[0][0] == last and met[0][1].__class__ is str:
            return []  # by far the most frequent case
        starts = word_starts(text, begin, end, words)
        found = []
        for i, word in met:
            if word.__class__ is not str:
                break
            if i < last:
                if words[i + 1][0].isalnum():
                    found.append((".", word, starts[i + 1] + i + 1, next_key(words, i + 1)))
                else:
                    at, key = first_key(text, starts[i] + i + len(words[i]), end)
                    if at >= 0:
                        found.append((".", word, at, key))
        else:
            return found  # nothing but full stops
        marks = []
        for i, x in met:
            at = starts[i] + i
            if x.__class__ is str:
                e = at + len(words[i])
                marks.append((e - 1, e, ".", i, x))
            else:
                for s, e, g in x:
                    marks.append((at + s, at + e, g, i, ""))
    ignored: set[int] = set()
    while True:
        found, stack, inner = [], [], -1
        for s, e, g, i, word in marks:
            c = g[0]
            if c == "." and e - s == 1:
                if e >= end:
                    inner = e
                    continue
                after = text[e]
                if after.isdigit():
                    continue
                if not stack and after.isspace():
                    inner = e
                    if not thai and i < last and words[i + 1][0].isalnum():
                        at, key = starts[i + 1] + i + 1, next_key(words, i + 1)
                    else:
                        at, key = first_key(text, e, end)
                    if at >= 0:
                        found.append((" ", "", at, key) if thai and THAI.match(text, s - 1) else (".", word or stop_key(text, s, begin), at, key))
                    continue
            if c in CLOSERS or c in "„«「『《(（[":
                if s in ignored:
                    continue
                if stack and c in CLOSERS and stack[-1][0] in CLOSERS[c]:
                    stack.pop()
                    if not stack and inner >= 0 and text[inner:s].strip() == "":
                        at, key = first_key(text, e, end)
                        if at >= 0 and (at > e or HAN.match(text[at])) and text[e : e + 1] not in ",;:，、；：.。":
                            found.append((")", "", at, key))
                elif c == '"' or c not in CLOSERS or (c == "“" and '"' not in [x for x, _ in stack]):
                    stack.append((c, s))
                continue
            if c.isspace():
                if not stack and (THAI.search(text, max(begin, s - 12), min(end, e + 4))):
                    at, key = first_key(text, e, end)
                    if at >= 0 and not (found and found[-1][2] == at):
                        found.append((" ", "", at, key))
                continue
            inner = e
            if stack or e >= end:
                continue
            if c in "。！？":
                at, key = first_key(text, e, end)
                if at >= 0 and text[at] not in "”」』》）)":
                    found.append(("。", "", at, key))
                continue
            if not text[e].isspace():
                if (text[e].isalpha() or (text[e] in "¡¿„«\"" and text[e + 1 : e + 2].isalpha())) and text[s - 1 : s].islower() and (c in "!?" or text[max(begin, s - 2) : s].islower()):
                    at, key = first_key(text, e, end)
                    found.append(("^", "", at, key))
                continue
            if c == ";" and not GREEK.search(text, max(begin, s - 3), s):
                continue
            at, key = first_key(text, e, end)
            if at < 0:
                continue
            mark = next((x for x in "!?؟।॥" if x in g), None) or ("…" if "…" in g or len(g) > 1 else c)
            found.append((mark, stop_key(text, s, begin) if mark == "." else "", at, key))
        if not stack:
            return found
        ignored.add(stack[0][1])


class Lexicon:
    """Learned scores in memory, for small collections and tests: rows (lang, kind, key, score), kinds as in ``learn``; "" holds all languages together."""

    def __init__(self, rows):
        self.scores = {(lang, kind, key): score for lang, kind, key, score in rows}

    def score(self, lang: str, kind: str, *keys: str) -> float | None:
        for key in keys:
            for own in (lang, ""):
                if (own, kind, key) in self.scores:
                    return self.scores[own, kind, key]
        return None

    def boundary(self, lang: str, mark: str, word: str, key: str) -> bool:
        short, _, longer = key.partition("\t")
        start = self.score(lang, "u", *([longer] if longer else []), short)
        if start is None:
            start = UNMET[0] if key[:1].islower() else UNMET[1] if key[:1] == "#" else UNMET[2]
        if mark != ".":
            return start + PRIOR[mark] > 0
        stop = self.score(lang, "t", word)
        together = self.score(lang, "c", f"{word}\t{longer or short}") or 0.0
        return start + (UNMET_STOP if stop is None else stop) - together > 0

    def boundaries(self, lang: str, text: str, begin: int, end: int) -> list[int]:
        """Where a segment's sentences other than the first begin."""
        return [at for mark, word, at, key in candidates(text, begin, end) if self.boundary(lang, mark, word, key)]


def sentences_of(lexicon: Lexicon, lang: str, text: str) -> list[tuple[int, int]]:
    out = []
    for s, e, body in segments(text):
        a = s
        for b in [*lexicon.boundaries(lang, text, body, e), e] if body >= 0 else (e,):
            piece = text[a:b]
            bare = piece.lstrip()
            start = b - len(bare)
            bare = bare.rstrip()
            if bare:
                out.append((start, start + len(bare)))
            a = b
    return out


class Words:
    """The words of many segments of prose, each distinct one looked at once: what it ends, what follows it, how often it is met.

    ``segments`` has (text's number, start, end, whether it holds a script with blanks for stops) of each.
    """

    def __init__(self, texts: list[str], segments: list[tuple[int, int, int, bool]]):
        self.texts, self.segments = texts, segments
        bare = [texts[t][s:e].strip() for t, s, e, _ in segments]
        lists = pc.utf8_split_whitespace(pa.array(bare, pa.large_string()))
        held = lists.flatten().dictionary_encode()
        self.words = held.dictionary.to_pylist()
        self.codes = held.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = lists.offsets.to_numpy().astype(np.int64)  # of each segment
        self.size = np.diff(self.first)
        self.of = np.repeat(np.arange(len(segments)), self.size)
        self.shapes = [_SHAPES[w] for w in self.words]
        self.lengths = np.array([len(w) for w in self.words], np.int64)[self.codes]
        before = np.concatenate([[0], np.cumsum(self.lengths + 1)])
        begin, end = (np.array([x[i] for x in segments], np.int64) for i in (1, 2))
        self.starts = before[:-1] - np.repeat(before[self.first[:-1]] - begin, self.size)
        self.regular = before[self.first[1:]] - before[self.first[:-1]] - 1 == end - begin  # one blank between any two words, none around them
        self.head = np.array([w[0].isalnum() and not SIGNS.match(w) for w in self.words], bool)
        self.lower, self.digit, self.alpha = (np.array(x, bool) for x in ([w[0].islower() for w in self.words], [w[0].isdigit() for w in self.words], [w.isalpha() for w in self.words]))
        self.number = np.array([w[0].isdigit() and not HAN.search(w) for w in self.words], bool)

    def keys(self, at: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Keys of the words at these places, which begin with letters or digits: the distinct ones, and which of them each has."""
        last = self.first[self.of[at] + 1] - 1
        codes, n = np.append(self.codes, [0, 0]), len(self.words) + 1
        one = codes[at]
        two, three = np.where(at + 1 <= last, codes[at + 1], -1), np.where(at + 2 <= last, codes[at + 2], -1)
        short = ~self.digit[one] & ((two < 0) | self.alpha[two])
        two = np.where(self.lower[one], -1, two)
        three = np.where(self.lower[one] | short, -1, three)
        if self.number.any():
            one = np.where(self.number[one], self.number.argmax(), one)  # what a number's digits are is not in its key
        pairs, which = np.unique(one * n + two + 1, return_inverse=True)
        triples, which = np.unique(which * n + three + 1, return_inverse=True)
        words = [*self.words, None]
        found = []
        for pair, c in zip(pairs[triples // n].tolist(), (triples % n - 1).tolist()):
            a, b = words[pair // n], pair % n - 1
            found.append(_KEYS[a] if a[0].islower() else word_key(a, words[b], words[c]))
        return found, which

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The word before each place of all segments whose words say it alone; the words that hold places, likewise; and the segments that are to be looked at one by one."""
        kinds, opens, shuts, ending, gluing, odd = (np.array([f(x) for x in self.shapes]) for f in (lambda x: x and x[0] or 0, lambda x: x and x[1] or 0, lambda x: x and x[2] or 0, lambda x: bool(x and x[3]), lambda x: bool(x and x[5]), lambda x: x is None))
        slow = np.array([x[3] for x in self.segments], bool)
        slow[self.of[odd[self.codes]]] = True
        # How many quotations and brackets are open before each word; none within another, none left open.
        depth = np.concatenate([[0], np.cumsum((opens - shuts)[self.codes])])
        slow[depth[self.first[1:]] != depth[self.first[:-1]]] = True
        base = depth[self.first[:-1]][self.of]
        before, after = depth[:-1] - base, depth[1:] - base
        pair = np.flatnonzero(kinds[self.codes])
        opened, shut, kind, of = opens[self.codes[pair]], shuts[self.codes[pair]], kinds[self.codes[pair]], self.of[pair]
        wrong = (after[pair] < 0) | (after[pair] > 1) | (opened > 0) & (before[pair] != 0)
        wrong[1:] |= (shut[1:] > opened[1:]) & (kind[1:] != kind[:-1]) & (of[1:] == of[:-1])
        slow[of[wrong]] = True
        stop = np.flatnonzero(ending[self.codes])
        stop = stop[(stop + 1 < self.first[self.of[stop] + 1]) & (after[stop] == 0)]
        slow[self.of[stop[~self.head[self.codes[stop + 1]]]]] = True
        within = np.flatnonzero(gluing[self.codes])
        within = within[before[within] == 0]
        for at in (stop, within):
            slow[self.of[at]] |= ~self.regular[self.of[at]]
        return stop[~slow[self.of[stop]]], within[~slow[self.of[within]]], np.flatnonzero(slow)

    def count(self, langs: list[str], held: dict[str, Tally]) -> None:
        """Add what is met to the counts of the texts' languages."""
        names = list(dict.fromkeys(langs))
        for lang in names:
            held.setdefault(lang, Tally())
        number = {lang: i for i, lang in enumerate(names)}
        text_of = np.array([x[0] for x in self.segments], np.int64)
        lang_of = np.array([number[lang] for lang in langs], np.int64)[text_of]
        n = len(self.words)

        def add(name: str, keys: np.ndarray, of: np.ndarray, total: int, named) -> None:
            cells, counts = np.unique(lang_of[of] * total + keys, return_counts=True)
            at = np.searchsorted(cells, np.arange(len(names) + 1) * total)
            for lang, a, b in zip(names, at, at[1:]):
                into = getattr(held[lang], name)
                for key, times in zip((cells[a:b] % total).tolist(), counts[a:b].tolist()):
                    into[named(key)] += times

        add("words", self.codes, self.of, n, self.words.__getitem__)
        capital = np.array([w[0].isalpha() and not w[0].islower() for w in self.words], bool)
        text = text_of[self.of]
        pairs = np.flatnonzero(capital[self.codes[:-1]] & (text[:-1] == text[1:]))
        add("capitals", self.codes[pairs] * n + self.codes[pairs + 1], self.of[pairs], n * n, lambda x: (self.words[x // n], self.words[x % n]))
        dot = np.array([w[-1] == "." for w in self.words], bool)
        last = self.first[1:] - 1
        ends = np.flatnonzero(dot[self.codes[last]])
        add("last", self.codes[last[ends]], ends, n, lambda x: _ended(self.words[x][:-1]))
        plain = [self.texts[t][s].isalnum() for t, s, _, _ in self.segments]
        begun = np.flatnonzero(plain)
        found, which = self.keys(self.first[begun])
        add("starts", which, begun, len(found) + 1, found.__getitem__)
        for i in np.flatnonzero(~np.array(plain, bool)).tolist():
            t, s, e, _ = self.segments[i]
            at, key = first_key(self.texts[t], s, e)
            if at >= 0:
                held[langs[t]].starts[key] += 1


#: Quotations and brackets that a word may begin in front and end behind.
OPENING, SHUTTING = {"(": 1, '"': 2, "«": 3, "“": 4, "„": 5}, {")": 1, '"': 2, "»": 3, "”": 4, "“": 5}


class Shapes(dict):
    """Word -> (kind of its quotation or bracket, whether it begins one, whether it ends one, mark at its end, key of the word before that, (offset, key) of places within), None if that depends on more than the word."""

    def __missing__(self, word: str) -> tuple | None:
        shape = _shape(word, _MARKS[word])
        if len(word) <= LONGEST:
            if len(self) > KEEP_KEYS:
                self.clear()
            self[word] = shape
        return shape


_SHAPES = Shapes()


def _shape(word: str, marks: tuple | str) -> tuple | None:
    if marks.__class__ is str:
        return 0, 0, 0, ".", marks, ()
    kind, opened, shut, mark, before, within, inner = 0, 0, 0, "", "", [], -1
    for s, e, g in marks:
        c = g[0]
        if mark or c in "。！？;":
            return None
        if c in ".!?…।॥؟":
            inner = e
            if e == len(word):
                mark = "." if g == "." else next((x for x in "!?؟।॥" if x in g), "…")
                before = ended(word[:-1]) if mark == "." else ""
            elif opened and not shut:
                pass  # within a quotation
            elif word[e] in "¡¿„«\"" and word[e + 1 : e + 2].isalpha():
                return None
            elif word[e].isalpha() and word[s - 1 : s].islower() and (c in "!?" or word[max(0, s - 2) : s].islower()):
                if kind or not word[e].islower():
                    return None
                within.append((e, _KEYS[word[e:]]))
        elif s == 0 and c in OPENING:
            kind, opened = OPENING[c], 1
        elif s and c in SHUTTING and not shut and kind in (0, SHUTTING[c]) and not within:
            kind, shut = SHUTTING[c], 1
            if inner == s:
                if e == len(word):
                    mark = ")"
                elif word[e] not in ",;:，、；：.。":
                    return None
        else:
            return None
    return kind, opened, shut, mark, before, tuple(within)


class Tally:
    """Counts of one language's certain starts (s), places behind other marks (q), ends of lines (e) and all words (n)."""

    def __init__(self):
        self.starts, self.behind, self.last, self.words, self.capitals = (Counter() for _ in range(5))

    def size(self) -> int:
        return sum(map(len, (self.starts, self.behind, self.last, self.words, self.capitals)))

    def cells(self) -> Counter:
        """(kind, key) -> n."""
        out: Counter = Counter()
        for key, n in self.starts.items():
            out["s", key] += n
        for head, n in self.behind.items():
            out["q", word_key(*_bare_head(head))] += n
        for word, n in self.last.items():
            out["e", word] += n
        for word, n in self.words.items():
            key = word_key(word.lstrip(OPENERS) or ".", "", "")
            if key[0] != "#":
                out["n", key] += n
            if word[-1] == "." and len(word) > 1:
                out["w", ended(word[:-1])] += n
        for (a, b), n in self.capitals.items():
            key = word_key(a, b, "").partition("\t")[2]
            if key:
                out["n", key] += n
        return out


def _bare_head(head) -> tuple[str, str, str]:
    """Three words without a sign or opening marks in front."""
    a, b, c = head
    if not a[0].isalnum():
        a = SIGNS.sub("", a).lstrip(OPENERS)
        if not a:
            a, b, c = (b.lstrip(OPENERS) or "."), c, ""
    return a, b, c


PLACE = "struct<mark: string, word: string, key: string, start_at: int, ended: int>"


def place_columns(*cols: list) -> pa.StructArray:
    """Marks, words, keys, starts, ends of what comes before, as a column; mark null for the start of a unit."""
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols or [[]] * 5, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()))], names=["mark", "word", "key", "start_at", "ended"])


def bare_end(text: str, begin: int, at: int) -> int:
    """End of what comes before ``at``, without white space."""
    while at > begin and text[at - 1].isspace():
        at -= 1
    return at


def all_places(words: Words) -> tuple[pa.StructArray, np.ndarray]:
    """The places of all segments, and the segment of each; a segment's are in order."""
    at, within, slow = words.places()
    found, which = words.keys(at + 1)
    code = words.codes[at]
    cols = [pa.array([x and x[i] for x in words.shapes], pa.string()).take(pa.array(code)) for i in (3, 4)]
    cols += [pa.array(found, pa.string()).take(pa.array(which)), pa.array(words.starts[at + 1], pa.int32()), pa.array(words.starts[at] + words.lengths[at], pa.int32())]
    plain = pa.StructArray.from_arrays(cols, names=["mark", "word", "key", "start_at", "ended"])
    rest, of = [], []
    for c, begin, i in zip(words.codes[within].tolist(), words.starts[within].tolist(), words.of[within].tolist()):
        for e, key in words.shapes[c][5]:
            rest.append(("^", "", key, begin + e, begin + e))
            of.append(i)
    for i in slow.tolist():
        t, s, e, thai = words.segments[i]
        text = words.texts[t]
        for mark, word, begin, key in candidates(text, s, e, thai):
            rest.append((mark, word, key, begin, begin - 1 if not text[begin - 2].isspace() and text[begin - 1].isspace() else bare_end(text, s, begin)))
            of.append(i)
    return pa.concat_arrays([plain, place_columns(*zip(*rest))]), np.concatenate([words.of[at], np.array(of, np.int64)])


def blocks(batches):
    """The batches in parts of about as many bytes of text as are looked at together; no text is cut."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(batch):
            size = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, side="right")) - at)
            yield batch.slice(at, size)
            at += size


def scan(texts: DataFrame, id_col: str | None, text_col: str, lang_col: str | None) -> DataFrame:
    """One pass over all texts: a row a text with its places (id, uid, lang, last, places), and rows with counts (lang, kind, key, n).

    The result is a table in the shared folder. ``last`` is where a text's last unit ends.
    """
    ident = F.col(id_col) if id_col else F.lit(None).cast("bigint")
    texts = texts.select(ident.alias("id"), F.col(text_col).alias("text"), (F.col(lang_col) if lang_col else F.lit(None).cast("string")).alias("label"))
    id_type = to_arrow_type(texts.schema["id"].dataType)

    def run(batches):
        gc.disable()  # millions of small objects, no cycles
        try:
            yield from scanned(batches)
        finally:
            gc.enable()

    def scanned(batches):
        held: dict[str, Tally] = {}

        def counts():
            cols: list[list] = [[], [], [], []]
            for lang, tally in held.items():
                for (kind, key), n in tally.cells().items():
                    for col, v in zip(cols, (lang, kind, key, n)):
                        col.append(v)
            held.clear()
            m = len(cols[0])
            return pa.RecordBatch.from_arrays([pa.nulls(m, id_type), pa.array(cols[0], pa.string()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.list_(place_columns().type)), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], names=NAMES)

        for batch in blocks(batches):
            rows, texts, langs, lasts, sizes = [], [], [], [], [0]
            starts, ends, parts, units_of = [], [], [], []
            for number, (text, label) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if not text:
                    continue
                units = segments(text)
                if not units:
                    continue
                lang = language(label, text)
                dense = not text.isascii() and bool(DENSE.search(text))
                before, t, lines = 0, len(texts), []
                for s, e, body in units:
                    begin = s
                    while begin < e and text[begin].isspace():
                        begin += 1
                    if body >= 0:
                        if bare_end(text, body, e) > body:
                            parts.append((t, body, e, dense and bool(THAI.search(text, body, e))))
                            units_of.append(len(starts))
                        lines.append(text[body:e])
                    starts.append(begin), ends.append(before)
                    before = bare_end(text, begin, e)
                if ":" in text and lines:
                    held.setdefault(lang, Tally()).behind.update(COLON.findall("\n".join(lines)))
                rows.append(number), texts.append(text), langs.append(lang), lasts.append(before), sizes.append(len(starts))
            places = place_columns([None] * len(starts), [None] * len(starts), [None] * len(starts), starts, ends)
            m = len(rows)
            if parts:
                words = Words(texts, parts)
                words.count(langs, held)
                found, unit = all_places(words)
                of = np.concatenate([np.arange(len(starts)), np.array(units_of)[unit]])
                places = pa.concat_arrays([places, found])
                order = np.lexsort((places.field("start_at").to_numpy(), np.arange(len(of)) >= len(starts), of))
                places = places.take(pa.array(order))
                sizes = np.searchsorted(of[order], sizes)
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), places)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())).cast(id_type), pa.array(langs, pa.string()), pa.array(lasts, pa.int32()), lists, pa.nulls(m, pa.string()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64())], names=NAMES)
            if sum(t.size() for t in held.values()) > FLUSH:
                yield counts()
        yield counts()

    columns = f"id {texts.schema['id'].dataType.simpleString()}, lang string, last int, places array<{PLACE}>, kind string, key string, n bigint"
    return written(texts.mapInArrow(run, columns).withColumn("uid", F.monotonically_increasing_id()))


NAMES = ["id", "lang", "last", "places", "kind", "key", "n"]


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(0.0)


def likelihood_ratio(k: Column, other: Column) -> Column:
    """Dunning's ratio of the hypotheses that k of k + other follow their own rate, or that both are as likely."""
    return 2 * (_xlogx(k) + _xlogx(other) - (k + other) * F.log((k + other) / 2))


def association_ratio(both: Column, left: Column, right: Column, total: Column) -> Column:
    """Dunning's ratio of the hypotheses that left and right meet by their own counts, or at a rate of their own."""
    a, b, c, d = both, left - both, right - both, total - left - right + both
    cells = _xlogx(a) + _xlogx(b) + _xlogx(c) + _xlogx(d)
    return 2 * (cells - _xlogx(left) - _xlogx(right) - _xlogx(total - left) - _xlogx(total - right) + _xlogx(total))


def learn(counts: DataFrame, stops: DataFrame) -> DataFrame:
    """(lang, kind, key, score) of all starters (u), words before a stop (t) and collocations (c), "" for all languages together.

    ``counts`` has (lang, kind, key, n), ``stops`` (lang, mark, word, key, n) of all places.
    """

    def per(of: DataFrame) -> DataFrame:
        return of.withColumn("lang", F.explode(F.array_distinct(F.array("lang", F.lit("")))))

    def total(*kinds: str) -> Column:
        return F.sum(F.when(F.col("kind").isin(*kinds), F.col("n")).otherwise(0))

    kind = F.when(F.col("mark") == ".", "p").when(F.col("mark").isin(")", " ", "…", "^"), "q").when(F.col("mark") == ";", None).otherwise("s")
    met = stops.select("lang", kind.alias("kind"), "key", "n").where("kind is not null")
    keys = counts.where("kind in ('s', 'q', 'n')").select("lang", "kind", "key", "n").unionByName(met)
    keys = keys.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).withColumn("key", F.explode(F.split("key", "\t"))).where("key <> ''")
    u = per(keys).groupBy("lang", "key").agg(total("s").cast("double").alias("s"), total("p", "q").cast("double").alias("a"), total("n").cast("double").alias("n"))
    other = F.greatest(F.col("n") - F.col("s") - F.col("a"), F.lit(0.0)) + F.col("a") * BEHIND_STOP
    u = u.where(f"s + a + n >= {LEAST} and s + a > 0").withColumn("other", other)
    # A word with what follows it counts only with evidence of its own; else the word alone does.
    u = u.where((~F.col("key").contains(" ")) | F.col("key").startswith("# ") | (F.col("s") + F.col("other") >= 3))
    sure = likelihood_ratio(F.col("s"), F.col("other")) >= SURE
    starts = written(u.select("lang", F.lit("u").alias("kind"), "key", F.when(sure, F.log((F.col("s") + 0.5) / (F.col("other") + 0.5))).otherwise(0.0).alias("score")))

    longest = F.element_at(F.split("key", "\t"), -1)
    pairs = per(stops.where("mark = '.'").select("lang", "word", longest.alias("key"), "n")).groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))
    pairs = pairs.join(starts.select("lang", "key", F.col("score").alias("start")), ["lang", "key"], "left")
    ends = per(counts.where("kind = 'e'").select("lang", F.col("key").alias("word"), "n")).select("lang", F.lit("").alias("key"), "word", "n", F.lit(1.0).alias("start"))
    pairs = written(pairs.unionByName(ends))

    t = pairs.groupBy("lang", "word").agg(F.sum(F.when(F.col("start") > 0, F.col("n")).otherwise(0)).cast("double").alias("e"), F.sum("n").cast("double").alias("n")).where(f"n >= {LEAST}")
    rate = per(counts.where("kind in ('n', 'w')")).select("lang", "kind", F.element_at(F.split("key", "\t"), 1).alias("word"), "n").where("not contains(word, ' ')")
    rate = rate.groupBy("lang", "word").agg(total("n").cast("double").alias("all"), total("w").cast("double").alias("with"))
    sums = rate.groupBy("lang").agg((F.sum("with") / F.greatest(F.sum("all"), F.lit(1.0))).alias("p"))
    w, bare = F.col("with"), F.greatest(F.col("all") - F.col("with"), F.lit(0.0))
    p = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(0.98))
    letters = F.length(F.regexp_replace("word", r"\.", ""))
    inner = F.length("word") - letters + 1
    abbreviation = (w * F.log(0.99 / p) + bare * F.log(0.01 / (1 - p))) * F.exp(-letters) * inner * F.pow(letters.cast("double"), -bare)
    rate = rate.where("with > 0 and word <> '#'").join(sums, "lang").select("lang", "word", abbreviation.alias("rates"))
    t = t.join(rate, ["lang", "word"], "left").withColumn("o", F.col("n") - F.col("e"))
    odds = F.log((F.col("e") + 1.0) / (F.col("o") + 0.35))
    t_score = F.when(likelihood_ratio(F.col("e"), F.col("o")) >= SURE, odds).when(F.col("rates") >= SURE_ABBREVIATION, F.least(odds, F.lit(ABBREVIATED))).otherwise(0.0)
    words = t.select("lang", F.lit("t").alias("kind"), F.col("word").alias("key"), t_score.alias("score"))

    real = pairs.where("key <> ''")
    right = real.groupBy("lang", "key").agg(F.sum("n").cast("double").alias("r"))
    left = real.groupBy("lang", "word").agg(F.sum("n").cast("double").alias("l"))
    whole = real.groupBy("lang").agg(F.sum("n").cast("double").alias("all"))
    # Numbers, single letters and abbreviations go together with what follows; other words merely stand before it.
    before = t.where((F.col("word") == "#") | F.col("word").rlike(r"^\p{L}$") | ((F.col("rates") >= SURE_ABBREVIATION) & (F.col("e") <= F.col("o")))).select("lang", "word")
    c = real.where(f"n >= {LEAST} and coalesce(start, 0) <= 0").join(before, ["lang", "word"], "left_semi").join(right, ["lang", "key"]).join(left, ["lang", "word"]).join(whole, "lang")
    n = F.col("n").cast("double")
    c = c.where((n * F.col("all") > F.col("l") * F.col("r")) & (association_ratio(n, F.col("l"), F.col("r"), F.col("all")) >= SURE_COLLOCATION))
    together = c.select("lang", F.lit("c").alias("kind"), F.concat_ws("\t", "word", "key").alias("key"), F.lit(COLLOCATED).alias("score"))
    return starts.unionByName(words).unionByName(together)


CASE = ("lang", "mark", "word", "key")


def verdicts(cases: DataFrame, learned: DataFrame) -> DataFrame:
    """``cases`` (lang, mark, word, key), distinct, with ``boundary``: each asks for its scores in one join, its own language's before all languages', longer keys before shorter."""
    short, longer = F.element_at(F.split("key", "\t"), 1), F.when(F.col("key").contains("\t"), F.element_at(F.split("key", "\t"), -1))
    stop = F.col("mark") == "."

    def ask(kind: str, key: Column, first: int):
        return [F.struct(F.lit(kind).alias("kind"), lang.alias("lang"), key.alias("key"), F.lit(first + i).alias("rank")) for i, lang in enumerate((F.col("lang"), F.lit("")))]

    asked = [*ask("u", longer, 0), *ask("u", short, 2), *ask("t", F.when(stop, F.col("word")), 0), *ask("c", F.when(stop, F.concat_ws("\t", "word", F.coalesce(longer, short))), 0)]
    rows = cases.select(F.struct(*CASE).alias("case"), F.explode(F.array(*asked)).alias("q")).select("case", "q.kind", "q.lang", "q.key", "q.rank").where("key is not null")
    found = rows.join(learned, ["kind", "lang", "key"], "left")

    def best(kind: str) -> Column:
        return F.min(F.when((F.col("kind") == kind) & F.col("score").isNotNull(), F.struct("rank", "score")))["score"]

    got = found.groupBy("case").agg(best("u").alias("u"), best("t").alias("t"), best("c").alias("c"))
    first = F.substring("case.key", 1, 1)
    unmet = F.when(first == "#", UNMET[1]).when(first.rlike(r"\p{Ll}"), UNMET[0]).otherwise(UNMET[2])
    prior = F.create_map(*[F.lit(x) for pair in PRIOR.items() for x in pair])[F.col("case.mark")]
    behind = F.when(F.col("case.mark") == ".", F.coalesce("t", F.lit(UNMET_STOP)) - F.coalesce("c", F.lit(0.0))).otherwise(prior)
    return got.select("case.*", (F.coalesce("u", unmet) + behind > 0).alias("boundary"))


def true_places(places: DataFrame, good: DataFrame) -> DataFrame:
    """Of places (mark, word, key, lang and more) those whose case is in ``good``, (lang, mark, word, key)."""
    # Two hashes of a case stand for it on the way; together they have 96 bits.
    hashes = (F.xxhash64(*CASE).alias("h1"), F.hash(*CASE).alias("h2"))
    rest = [c for c in places.columns if c not in CASE]
    return places.where("mark is not null").select(*rest, *hashes).join(good.select(*hashes), ["h1", "h2"], "left_semi").select(*rest)


def learned_cases(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, mark, word, key, n) of all cases met in a scan, and what is learned from it."""
    places = scanned.where("kind is null").select("lang", F.explode("places").alias("p")).select("lang", "p.mark", "p.word", "p.key").where("mark is not null")
    cases = written(places.groupBy(*CASE).agg(F.count("*").alias("n")))
    return cases, learn(scanned.where("kind is not null").select("lang", "kind", "key", "n"), cases)


def split_sentences(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, start_at, end_at) of every sentence, in characters, end exclusive, without outer white space.

    A heading, bulleted item, table row or chain on one line is one unit; numbered
    steps and prose are cut into sentences; lines of prose wrapped at one width are
    read on. Null, empty and blank texts have no row. A missing or wrong language
    label falls back to the counts of all languages. Repeated rows give repeated
    rows, other columns are ignored, an empty table gives an empty result.
    """
    scanned = scan(texts, id_col, text_col, lang_col)
    cases, learned = learned_cases(scanned)
    good = verdicts(cases.select(*CASE), learned).where("boundary")
    whole = scanned.where("kind is null")
    places = whole.select("uid", "id", "lang", F.explode("places").alias("p")).select("uid", "id", "lang", "p.*")
    heads = places.where("mark is null").select("uid", "id", "start_at", "ended")
    ends = whole.select("uid", "id", F.lit(2**31 - 1).alias("start_at"), F.col("last").alias("ended"))
    cuts = heads.unionByName(ends).unionByName(true_places(places, good).select("uid", "id", "start_at", "ended"))
    end = F.lead("ended").over(Window.partitionBy("uid").orderBy("start_at"))
    found = cuts.withColumn("end_at", end).where("end_at is not null")
    return found.select(F.col("id").alias(id_col), "start_at", "end_at")
