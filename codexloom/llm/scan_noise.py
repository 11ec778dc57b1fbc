"""Noise of scanned pages: broken words, misread words, running headers, page numbers.

The corpus gives two tables; what is broadcast of them is bounded by a share:

* its vocabulary, the words and compounds that make up at least WORD_SHARE of all words
  (so at most 1 / WORD_SHARE of them), each with its count and the share of filings that
  use it;
* its running lines, short unpunctuated lines whose fuzzy form (digits masked, look-alike
  letters merged, names masked) stands LINE_REPEATS times in one filing or in LINE_REPEATS
  sections of the corpus, at least EDGE_SHARE of them at a page's edge: beside a page
  number, or across a word or sentence that goes on after them. Each section gets its filing's own that it has; only for sections
  of filings that were not learned from, the forms that also make up LINE_SHARE of all are
  broadcast.

A section is then read line by line. Page numbers and running lines that stand between
lines of prose are removed, words broken by a hyphen at a line's end are joined by the
vocabulary, words that the vocabulary doesn't know but that become frequent words when
look-alike letters are exchanged are corrected, and lines are joined to paragraphs.
Chunks have lost their line ends; they get the noise that was found in their section
wherever its words stand in them, and are read on their own if their section is missing.
What ``source`` says plays no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexloom.runtime import cut_lineage, shipped

WORD_SHARE, LINE_SHARE, LINE_REPEATS = 5e-6, 1e-5, 3
#: A page may also end with a sentence, so not every edge can be told.
EDGE_SHARE = 0.25
#: A word is common when this share of filings uses it; names are not.
COMMON = 0.04
#: A correction must be so many times as frequent as the word it replaces.
RATIO, SHORT_RATIO = 8.0, 40.0
#: Look-alikes in one word that are exchanged at most.
EXCHANGES = 3
_FAR = (1 << 30, "")
KINDS = ("hyphen", "misread", "header", "pageno")

#: What recognition makes of letters: (seen, meant). Fixed values.
LOOKALIKES = [("c", "e"), ("u", "a"), ("f", "t"), ("1", "i"), ("1", "l"), ("5", "s"), ("0", "o"), ("cl", "d"), ("m", "in"), ("9", "g"), ("rn", "m"), ("ii", "u"), ("b", "h"), ("6", "b"), ("vv", "w"), ("h", "li"), ("U", "ll"), ("d", "cl"), ("8", "b"), ("rm", "nn"), ("I", "l")]
_DIGIT_FOR = str.maketrans({"1": "l", "0": "o", "5": "s", "6": "b", "9": "g", "8": "b"})
_DIGIT_INSIDE = re.compile(r"[a-z][01569][a-z]|^[01569][a-z]{3,}|[a-z]{3,}[01569]$")
_CODE = re.compile(r"\d+(?:st|nd|rd|th|[a-z])|[a-z]{1,2}\d+|v\d+|[A-Z\d]+")
_POSSESSIVE = re.compile(r"(.*)(['’]s?)")
_CANON1 = str.maketrans({"c": "e", "d": "el", "f": "t", "1": "l", "i": "l", "5": "s", "0": "o", "9": "g", "m": "ln", "w": "vv"} | dict.fromkeys("uahb68", "ll"))
_CANON2 = [("nn", "rln"), ("rn", "ln")]
_ORDINALS = frozenset("first second third fourth fifth sixth seventh eighth ninth tenth".split())
_HYPHENS = "-­‐‑¬"
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_TAIL = re.compile(r"[\w'’]*")
_LETTERS = re.compile(r"[^\W\d_]+")
_MARKED_PAGE = re.compile(r"(?i)^(?:[-–—]\s*\d{1,4}\s*[-–—]|\[\s*\d{1,4}\s*\]|\d{1,4}\s*\|\s*p\s?[au]\s?g\s?[ec]|p[au]g[ec]\s+\d{1,4}(?:\s*(?:of|o[ft]|/)\s*\d{1,4})?|seite\s+\d{1,4}|[A-Z]-\d{1,3})$")
_BARE_PAGE = re.compile(r"^(?:\d{1,4}|(?=[ivxl])(?:xc|xl|l?x{0,4})(?:ix|iv|v?i{0,4}))$")
_CELL = re.compile(r"(?i)^(?:[\s$€£\d.,:;%|/()+–-]|to|x)+$")
_GAP = re.compile(r"\s{2,}|\t")
_ENUMERATED = re.compile(r"^\s*(?:\([a-z0-9]{1,4}\)|[•*]|\d{1,2}[.)])\s")
_INLINE_PAGE = re.compile(r"(?<=\s)(?:- \d{1,4} -|\[\d{1,4}\]|\d{1,4} \| P a g e|Page \d{1,4} of \d{1,4}|S-\d{1,3})(?=\s)")


@dataclass
class Corpus:
    """The vocabulary (count, share of filings) and the running lines' fuzzy forms.

    ``own`` has (d, i, own): of each section learned from that has running lines of its
    filing ``d``, their forms.
    """

    words: dict = field(default_factory=dict)
    lines: frozenset = frozenset()
    own: DataFrame | None = None

    def __post_init__(self) -> None:
        self._fixes: dict[str, str | None] = {}
        #: Corrections of the words read so far.
        self.seen: dict[str, str | None] = {}
        self.top = max((c for c, _ in self.words.values()), default=0)
        self._likes: dict[str, list[str]] = {}
        for w, (_, share) in self.words.items():
            if share >= COMMON:
                self._likes.setdefault(_canon(w.rstrip("-")), []).append(w.rstrip("-"))

    def count(self, w: str) -> int:
        """Of the word, or of its suspended form (short- and long-term)."""
        return (self.words.get(w) or self.words.get(w + "-") or (0, 0.0))[0]

    def common(self, w: str) -> bool:
        return (self.words.get(w) or self.words.get(w + "-") or (0, 0.0))[1] >= COMMON

    def corrected(self, word: str) -> str | None:
        """The corrected form of a word with its suffix or compound parts, or None."""
        if word not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[word] = _corrected(word, self)
        return self.seen[word]

    def correction(self, word: str) -> str | None:
        """What ``word`` was before it was misread, or None."""
        if word not in self._fixes:
            if len(self._fixes) > 200_000:
                self._fixes.clear()
            self._fixes[word] = self._correct(word)
        return self._fixes[word]

    def _correct(self, word: str) -> str | None:
        low = word.lower()
        own = self.count(low)
        if len(word) < 2 or word.isdigit() or own > self.top / RATIO:
            return None
        digits, letters = (0, len(word)) if word.isalpha() else (sum(c.isdigit() for c in word), sum(c.isalpha() for c in word))
        if letters < 2 or (digits and (digits > 3 or digits > letters or _CODE.fullmatch(word))):
            return None
        likes = self._likes.get(_canon(low))
        if not likes:
            return self._digits_out(word) if digits and letters >= 3 else None
        least = (RATIO if len(word) > 3 else SHORT_RATIO) * max(1, own)
        # Two exchanges in one word are likelier in a word that nobody knows.
        most = 1 if self.common(low) else EXCHANGES
        best = None
        for target in likes:
            c = self.count(target)
            if target != low and c >= least and (got := exchanged(word, target, most)):
                # The fewest exchanges win, then the most frequent word.
                best = min(best or (got[0], -c, got[1]), (got[0], -c, got[1]))
        return best[2] if best else self._digits_out(word)

    @staticmethod
    def _digits_out(word: str) -> str | None:
        """A digit inside letters is misread even where the word is unknown."""
        if any(c.isdigit() for c in word) and _DIGIT_INSIDE.search(word):
            plain = word.translate(_DIGIT_FOR)
            return plain if plain.isalpha() else None
        return None


def fuzzy(line: str, corpus: Corpus) -> set[str]:
    """The forms under which repetitions of a running line are counted.

    Both mask digits and merge look-alikes; the second also masks names, unless that
    would leave nothing.
    """
    plain, masked = [], []
    for w in line.split():
        core = w.strip(".,:;()[]").lower()
        if any(c.isdigit() for c in core) and not any(c.isalpha() for c in core):
            x = y = "#"
        elif not any(c.isalnum() for c in core):
            x = y = w
        elif core in _ORDINALS:
            x = y = "nth"
        else:
            fixed = core if corpus.common(core) else (corpus.correction(core) or core)
            x = _canon(fixed)
            y = x if corpus.common(fixed) else "~"
        plain.append(x)
        masked.append(y)
    # A name is one mask, however many words it has.
    out = {" ".join(plain), re.sub(r"~(?: ~)+", "~", " ".join(masked))}
    return {f for f in out if not set(f) <= set("~#/-| ")}


def _canon(w: str) -> str:
    """One form for all words that exchanges of look-alikes turn into each other."""
    w = w.translate(_CANON1)
    for a, b in _CANON2:
        w = w.replace(a, b)
    return w


def exchanged(word: str, target: str, most: int) -> tuple[int, str] | None:
    """(exchanges, corrected word) if at most ``most`` look-alikes turn ``word`` into ``target``.

    The exchanges stand side by side; of all ways one with the fewest is taken. ``target``
    is in lower case; letters that are not exchanged keep their case.
    """
    low = word.lower()
    # For each place in the word: what of the target may be written by then, and how.
    ways: list[dict[int, tuple[int, str]]] = [{} for _ in range(len(word) + 1)]
    ways[0][0] = (0, "")
    for i, here in enumerate(ways[:-1]):
        if not here:
            continue
        swaps = [(len(a), b) for a, b in LOOKALIKES if word.startswith(a, i)]
        for j, (n, out) in here.items():
            if j < len(target) and low[i] == target[j] and ways[i + 1].get(j + 1, _FAR)[0] > n:
                ways[i + 1][j + 1] = (n, out + word[i])
            if n < most:
                for step, b in swaps:
                    if target.startswith(b, j) and ways[i + step].get(j + len(b), _FAR)[0] > n + 1:
                        ways[i + step][j + len(b)] = (n + 1, out + b)
    return ways[-1].get(len(target))


def running_form(line: str) -> bool:
    """Whether a line can be a running header at all: short, a heading's letters, no stop."""
    s = line.strip()
    if not s or len(s) > 80 or s[-1] in ".;:,!?" or _MARKED_PAGE.match(s):
        return False
    ws = s.split()
    if not 1 <= len(ws) <= 9 or s[-1] in ".;:,!?" or s[0] in "($“" or _CELL.match(s) or "|" in s:
        return False
    heads = [w for w in ws if w[0].isalpha()]
    if not heads or len(s) < 5 or "," in s or re.search(r"\d+\.\d+ to \d|(?i:\bsection \d)", s):
        return False
    return sum(w[0].isupper() for w in heads) >= 0.75 * len(heads) or (len(heads) <= 2 and heads[0][0].isupper() and sum(c.isdigit() for c in s) >= 4)


def _plain(line: str) -> bool:
    """Whether a line is too long for what runs at a page's edge, and has no gaps that part it."""
    return len(line) > 80 and "  " not in line and "\t" not in line


def _split_line(line: str) -> list[str]:
    line = line.strip()
    if "  " not in line and "\t" not in line:
        return [line] if line else []
    return [p for p in _GAP.split(line) if p]


def candidates(text: str) -> Iterator[tuple[str, bool]]:
    """Lines of ``text`` that can run, and whether each certainly stands at a page's edge."""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    # Only a line beside other lines can run at a page's edge.
    if len(lines) < 2:
        return
    split = [_split_line(x) for x in lines]
    plain = [_plain(x) for x in lines]
    if all(plain):
        return
    marked = [not far and any(_MARKED_PAGE.match(p) for p in ps) for far, ps in zip(plain, split)]
    running = [not far and all(_MARKED_PAGE.match(p) or _BARE_PAGE.match(p) or running_form(p) for p in ps) for far, ps in zip(plain, split)]
    i = 0
    while i < len(lines):
        if not running[i]:
            if not plain[i]:
                yield from ((p, False) for p in split[i] if running_form(p))
            i += 1
            continue
        # Lines that can run and page numbers stand together between two lines of text.
        j = i
        while j < len(lines) and running[j]:
            j += 1
        edge = any(marked[i:j])
        if not edge and i and j < len(lines):
            before, after = lines[i - 1], lines[j]
            if not _CELL.match(before) and not _CELL.match(after):
                broken = before[-1] not in ".;:!?" and len(_LETTERS.findall(before)) >= 3
                goes_on = after[0].islower() or (len(before) >= 40 and not _ENUMERATED.match(after))
                edge = (broken and goes_on) or (before[-1] in _HYPHENS and after[0].isalpha()) or any(_BARE_PAGE.match(p) for ps in split[i:j] for p in ps)
        yield from ((p, edge) for ps in split[i:j] for p in ps if running_form(p))
        i = j


@dataclass
class Finding:
    """Noise as it stands in the text: kind, the words before, its own, and those after."""

    kind: str
    before: str
    item: str
    after: str
    repaired: str


def _page_numbers(bare: list[str]) -> set[str]:
    """Bare numbers that are pages even among a table's cells.

    Roman ones of two letters or more are, and so are numbers below 1000 of one length
    that count up by one, and numbers of a length that few of the table's have.
    """
    out = {x for x in bare if not x.isdigit() and len(x) > 1}
    numbers = [x for x in bare if x.isdigit()]
    for width, n in Counter(map(len, numbers)).items():
        own = [int(x) for x in numbers if len(x) == width]
        steps = sum(b == a + 1 for a, b in zip(own, own[1:]))
        if (width < 4 and n > 2 and steps >= 0.8 * (n - 1)) or (len(numbers) > 5 and n <= 0.1 * len(numbers)):
            out |= {x for x in numbers if len(x) == width}
    return out


def _line_kinds(lines: list[str], corpus: Corpus, running: frozenset | set) -> list[list[tuple[str, str]]]:
    """For each line its parts as (kind, text); kind is '', 'header' or 'pageno'."""
    solid = [i for i, x in enumerate(lines) if x.strip()]
    out: list[list[tuple[str, str]]] = [[] for _ in lines]
    near = {i: (solid[k - 1] if k else None, solid[k + 1] if k + 1 < len(solid) else None) for k, i in enumerate(solid)}

    def header(part: str) -> bool:
        return running_form(part) and not running.isdisjoint(fuzzy(part, corpus))

    marks = {}
    apart = _page_numbers([x for i in solid if len(lines[i]) < 20 and _BARE_PAGE.match(x := lines[i].strip())])
    for i in solid:
        # Nothing that runs at a page's edge ends like a sentence.
        if lines[i].rstrip()[-1] in ".;:," or _plain(lines[i].strip()):
            marks[i] = [""]
            continue
        parts = _split_line(lines[i])
        marks[i] = [("pageno" if _MARKED_PAGE.match(p) else "bare" if _BARE_PAGE.match(p) else "header" if header(p) else "") for p in parts]
    for i in solid:
        if not any(marks[i]):
            out[i] = [("", lines[i])]
            continue
        parts, kinds = _split_line(lines[i]), list(marks[i])
        if len(parts) > 1 and not all(kinds):
            out[i] = [("", lines[i])]
            continue
        if kinds == ["bare"]:
            around = [j for j in near[i] if j is not None]
            prose = [j for j in around if (not _CELL.match(lines[j].strip()) and len(_LETTERS.findall(lines[j])) >= 3) or any(k in ("header", "pageno") for k in marks[j])]
            cells = [j for j in around if _CELL.match(lines[j].strip()) and not any(k == "pageno" for k in marks[j])]
            kinds = ["pageno"] if (prose and not cells) or lines[i].strip() in apart else [""]
        elif kinds == ["header"]:
            # A section's sole line is its text; edges were tested where forms were counted.
            p, n = near[i]
            if p is None and n is None:
                kinds = [""]
        kinds = ["pageno" if k == "bare" else k for k in kinds]
        out[i] = list(zip(kinds, parts)) if any(kinds) else [("", lines[i])]
    return out


def _broken(word: str) -> tuple[str, str] | None:
    """The last part of ``word`` and its hyphen, if it ends with one after a letter."""
    if word[-1:] not in _HYPHENS or not word:
        return None
    part = _TAIL.match(word[-2::-1]).group()[::-1] if len(word) > 1 else ""
    return (part, word[-1]) if any(c.isalpha() for c in re.split("['’]", part)[-1]) else None


def _joins(a: str, hyphen: str, b: str, corpus: Corpus) -> bool:
    """Whether ``a`` + hyphen at a line's end + ``b`` is one broken word."""
    if not b or not b[0].isalpha():
        return False
    if hyphen in "­‐‑¬":
        return True
    la, lb = a.lower(), b.lower()
    fixed = [(x, y) for x in {la, corpus.correction(la) or la} for y in {lb, corpus.correction(lb) or lb}]
    if lb in ("and", "or", "to") and any(corpus.count(x) for x, _ in fixed):
        return False
    whole = la + lb
    together = max(corpus.count(whole), corpus.count(corpus.correction(whole) or whole))
    apart = max(max(corpus.count(f"{x}-{y}"), corpus.count(f"{x}-")) for x, y in fixed)
    if together or apart:
        return together > apart
    return not (corpus.common(la) and corpus.common(lb))


def read(text: str | None, corpus: Corpus, own: set | None = None) -> tuple[list[Finding], str]:
    """The findings in a section's ``text``, and the text repaired into paragraphs.

    ``own`` are the forms of its filing's running lines, the corpus's if None.
    """
    if not text or text.isspace():
        return [], text or ""
    lines = text.split("\n")
    kinds = _line_kinds(lines, corpus, corpus.lines if own is None else own) if len(lines) > 1 else [[("", text)]]
    found: list[Finding] = []
    flat: list[str] = []
    where: list[tuple[int, str, int]] = []  # noise lines: position in flat, kind, words
    kept: list[tuple[int, str]] = []
    gap: dict[int, bool] = {}
    blank = removed = False
    # Places of words are needed only where something is found beside them.
    placed = any(kind for parts in kinds for kind, _ in parts) or any(h in text for h in _HYPHENS)
    for i, parts in enumerate(kinds):
        if not parts:
            blank = True
            continue
        for kind, part in parts:
            ws = part.split() if placed else []
            if kind:
                where.append((len(flat), kind, len(ws)))
                removed = True
            else:
                gap[len(kept)] = blank and not removed
                kept.append((len(flat), part))
                blank = removed = False
            flat += ws
        if any(k for k, _ in parts):
            blank = False
    for at, kind, n in where:
        found.append(Finding(kind, flat[at - 1] if at else "", " ".join(flat[at : at + n]), flat[at + n] if at + n < len(flat) else "", ""))
    width = max((len(p) for _, p in kept), default=0)
    wrapped = len(kept) >= 2 and width <= 120
    built: list[list[str]] = []
    for k, (at, part) in enumerate(kept):
        line = part.strip()
        prev = kept[k - 1][1].rstrip() if built else ""
        # The last word alone, whole: no pattern is tried over a long line.
        m = _broken(prev.rsplit(None, 1)[-1]) if prev and not gap[k] else None
        if m and _WORD.match(line):
            raw_at = kept[k - 1][0] + len(prev.split()) - 1
            b = re.match(r"[^\W\d_]\w*|\d?[^\W_]+", line)
            if b and _joins(*m, b.group(0), corpus):
                found.append(Finding("hyphen", flat[raw_at - 1] if raw_at else "", flat[raw_at], flat[raw_at + 1] if raw_at + 1 < len(flat) else "", ""))
                built[-1][-1] = built[-1][-1].rstrip()[:-1]
                built[-1].append(line)
            else:
                natural = m[1] == "-" and b and b.group(0).lower() not in ("and", "or", "to")
                built[-1] += [line] if natural else [" ", line]
            continue
        runs_on = False
        if built and not gap[k] and not _ENUMERATED.match(line) and not (_CELL.match(line) and "|" in line):
            runs_on = wrapped and not (len(prev) < 120 and (_CELL.match(prev) or _CELL.match(line) or "   " in prev) and len(prev.split()) < 6) and (prev[-1] not in ".;:!?" or len(prev) > 0.75 * width)
        if runs_on:
            built[-1] += [" ", line]
        else:
            built.append([line])
    whole, known = "\n".join("".join(x) for x in built), corpus.seen
    fixes = {w: fixed for w in set(_WORD.findall(whole)) if (fixed := known[w] if w in known else corpus.corrected(w))}
    if fixes:
        whole = _WORD.sub(lambda m: fixes.get(m.group(), m.group()), whole)
    # Sorted, so that a section's findings are the same whenever it is read.
    found += [Finding("misread", "", w, "", fixes[w]) for w in sorted(fixes)]
    return found, whole


def _corrected(w: str, corpus: Corpus) -> str | None:
    """The corrected form of a word, compounds part by part. Numbers and dates are none."""
    if w.lower() == w.upper():
        return None
    if "-" in w:
        if whole := corpus.correction(w):
            return whole
        if corpus.count(w.lower()):
            return None
        parts = w.split("-")
        fixed = [corpus.correction(x) or x for x in parts]
        return "-".join(fixed) if fixed != parts else None
    if m := _POSSESSIVE.fullmatch(w):
        fixed = corpus.correction(m.group(1))
        return fixed + m.group(2) if fixed else None
    return corpus.correction(w)


def read_chunk(text: str | None, findings: list[Finding] | None, corpus: Corpus) -> tuple[set[str], str]:
    """Kinds of noise in a chunk, and its repaired text.

    ``findings`` are those of its section, None if there is no such section.
    """
    if not text or text.isspace():
        return set(), text or ""
    kinds: set[str] = set()
    if findings is None:
        for m in _INLINE_PAGE.finditer(text):
            kinds.add("pageno")
        findings = []
        ws = text.split()
        for k, w in enumerate(ws[:-1]):
            m = _broken(w)
            b = re.match(r"[^\W\d_]\w*", ws[k + 1])
            if m and b and _joins(*m, b.group(0), corpus):
                findings.append(Finding("hyphen", ws[k - 1] if k else "", w, ws[k + 1], ""))
        findings += [Finding("misread", "", w, "", f) for w in {x for x in _WORD.findall(text)} if (f := corpus.corrected(w))]
        text_out = _INLINE_PAGE.sub("", text)
    else:
        text_out = text
    padded, out = f" {' '.join(text.split())} ", f" {' '.join(text_out.split())} "
    own = None
    for f in sorted(findings, key=lambda f: f.kind == "misread"):
        if f.kind == "misread":
            own = set(_WORD.findall(out)) | set(_WORD.findall(text)) if own is None else own
            if f.item in own:
                kinds.add("misread")
                out = re.sub(rf"(?<![^\W_]){re.escape(f.item)}(?![^\W_])", lambda _, r=f.repaired: r, out)
            continue
        for left, right in ((f.before, f.after), ("", f.after), (f.before, "")):
            full = " ".join(x for x in (left, f.item, right) if x)
            edge = (not left and f.before and not padded.startswith(f" {full} ")) or (not right and f.after and not padded.endswith(f" {full} "))
            if not edge and f" {full} " in padded:
                kinds.add(f.kind)
                if f.kind == "hyphen":
                    out = out.replace(f" {f.item} {f.after}", f" {f.item[:-1]}{f.after}") if right else out
                else:
                    out = out.replace(f" {full} ", f" {' '.join(x for x in (left, right) if x)} ".replace("  ", " "), 1)
                break
    return kinds, out.strip()


# ------------------------------------------------------------------ over tables
_TOKEN = r"[a-z]+(?:-[a-z]+)*-?"


def _key(id_: Column, text: Column) -> Column:
    """What tells sections apart: the id, or the text where there is none."""
    return F.coalesce(id_.cast("string"), F.xxhash64(text).cast("string"))


def learn(sections: DataFrame, id_col: str = "id", text_col: str = "text", doc_col: str = "document_id", word_share: float = WORD_SHARE, line_share: float = LINE_SHARE, repeats: int = LINE_REPEATS) -> Corpus:
    """Vocabulary and running lines of all ``sections``; what reaches the driver is bounded.

    Running lines are counted once for each section id, however often it is delivered.
    """
    rows = sections.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.coalesce(F.col(doc_col), F.lit("")).alias("d"))
    # Words at a line's end may be halves; a hyphen inside a line is the word's own.
    # Each word is tried once, from its start, and never given back letter by letter.
    inner = F.regexp_replace(F.lower("t"), rf"\b[a-z]++[{_HYPHENS}][ \t]*\n", "\n")
    words = rows.select("d", F.explode(F.regexp_extract_all(inner, F.lit(_TOKEN), F.lit(0))).alias("w"))
    per_doc = words.groupBy("w", "d").agg(F.count(F.lit(1)).alias("c"))
    stats = per_doc.groupBy("w").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("df"))
    totals = rows.agg(F.countDistinct("d").alias("docs")).crossJoin(stats.agg(F.sum("c").alias("all")))
    kept = stats.crossJoin(F.broadcast(totals)).where((F.col("c") >= 2) & (F.col("c") >= word_share * F.col("all")))
    table = {r.w: (r.c, r.df / r.docs) for r in kept.collect()}
    corpus = Corpus(table)

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, i, text in zip(pdf["d"], pdf["i"], pdf["t"]):
                seen, edges = Counter(), Counter()
                for line, edge in candidates(text):
                    for f in fuzzy(line, corpus):
                        seen[f] += 1
                        edges[f] += edge
                out += [(d, i, f, n, edges[f]) for f, n in seen.items()]
            if out:
                yield pd.DataFrame(out, columns=["d", "i", "f", "n", "e"])

    named = rows.select("d", _key(F.col("i"), F.col("t")).alias("i"), "t")
    once = named.transform(shipped).mapInPandas(forms, "d string, i string, f string, n long, e long").groupBy("d", "i", "f").agg(F.max("n").alias("n"), F.max("e").alias("e"))
    once = cut_lineage(once)
    counts = once.groupBy("d", "f").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.count(F.lit(1)).alias("s"))
    at_edges = F.col("e") >= EDGE_SHARE * F.col("n")
    wide = counts.groupBy("f").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("e").alias("e")).where((F.col("s") >= repeats) & at_edges).select("f", "s")
    every = counts.agg(F.sum("s").alias("all"))
    lines = wide.crossJoin(F.broadcast(every)).where(F.col("s") >= line_share * F.col("all")).select("f")
    own = counts.join(wide.select("f", F.lit(True).alias("wide")), "f", "left").where(F.col("wide") | ((F.col("n") >= repeats) & at_edges)).select("d", "f")
    # Each section gets those of its filing's running lines that it has itself.
    its = once.select("d", "i", "f").join(own, ["d", "f"]).groupBy("d", "i").agg(F.collect_set("f").alias("own"))
    return Corpus(table, frozenset(r.f for r in lines.collect()), its)


_FOUND = "array<struct<kind:string,before:string,item:string,after:string,repaired:string>>"


def read_sections(sections: DataFrame, corpus: Corpus, id_col: str = "id", text_col: str = "text", doc_col: str = "document_id") -> DataFrame:
    """(id, findings, repaired) for every row of ``sections``.

    A section of a filing that ``corpus`` was learned from has that filing's running lines.

    Null, empty and blank texts have no findings and come back as they are (null as
    empty). Rows with null ids are read too; repeated rows give repeated results.
    """
    shared = sections.sparkSession.sparkContext.broadcast((corpus.words, corpus.lines))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Corpus(*shared.value)
        for pdf in batches:
            got = [read(t, own, None if o is None else set(o)) for t, o in zip(pdf["t"], pdf["own"])]
            if not got:
                continue
            yield pd.DataFrame({"id": pdf["i"], "findings": [[vars(f) for f in fs] for fs, _ in got], "repaired": [r for _, r in got]})

    rows = sections.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.coalesce(F.col(doc_col), F.lit("")).alias("d"), _key(F.col(id_col), F.col(text_col)).alias("k"))
    joined = rows.withColumn("own", F.lit(None).cast("array<string>")) if corpus.own is None else rows.join(corpus.own.withColumnRenamed("i", "k"), ["d", "k"], "left")
    return joined.select("i", "t", "own").transform(shipped).mapInPandas(run, f"id string, findings {_FOUND}, repaired string")


def read_chunks(chunks: DataFrame, read_rows: DataFrame, corpus: Corpus, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, kinds, repaired) for every row of ``chunks``, by the findings of their sections.

    A chunk whose section is not among ``read_rows`` is read by its own words.
    """
    shared = chunks.sparkSession.sparkContext.broadcast((corpus.words, corpus.lines))
    base = chunks.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.regexp_replace(F.col(id_col), r"::p\d+$", "").alias("s"))
    by = read_rows.groupBy(F.col("id").alias("s")).agg(F.max("findings").alias("findings"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Corpus(*shared.value)
        for pdf in batches:
            got = [read_chunk(t, None if fs is None else [Finding(**f) for f in fs], own) for t, fs in zip(pdf["t"], pdf["findings"])]
            if not got:
                continue
            yield pd.DataFrame({"id": pdf["i"], "kinds": [sorted(k) for k, _ in got], "repaired": [r for _, r in got]})

    return base.join(by, "s", "left").select("i", "t", "findings").transform(shipped).mapInPandas(run, "id string, kinds array<string>, repaired string")
