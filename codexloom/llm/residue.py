"""Template residue, filler, error pages and script notices in place of content.

A record is residue when its text holds an unfilled placeholder, or consists of
filler, error messages or script notices, a title and navigation lines aside.

Placeholders follow delimiter-specific grammars: a pair of delimiters that template
languages use around an identifier, or brackets around an instruction to fill in.
Brackets that legal prose uses itself ([sic], [Reserved], {the "Obligors"}, [38]) match
none of them. Placeholders inside code, and in a text that explains templates, are
discounted by their surroundings: a fenced code block, an indented one that looks like
code, an inline code span, quotation marks around the placeholder in a line that speaks of
placeholders, or a sentence that tells how one is written. A text is a tutorial, and all its
placeholders examples, if words that only speak of templates are dense in it: MANUAL_SHARE of
its words, at least MANUAL_WORDS of them. The density of the placeholders themselves clears
nothing, since one that was left unfilled makes a record residue however long it is.

The rest of a text is taken apart into sentences. Each is residue (filler, error,
notice), navigation, a title, or content; one sentence of content clears the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexloom.runtime import shipped

_NAME = r"[A-Za-z][\w.\- ]{0,60}"
_FILL_IN = r"(?:please\s+)?(?:insert|enter|fill in|type|add|specify|your)\s+"
#: Grammars by delimiter; an instruction ends with its bracket, however long it is. Fixed values.
PLACEHOLDERS = {
    "double_brace": r"\{\{[{%]?\s*[#/>^&!]?\s*[\w.\-| ]{1,80}\s*\}\}",
    "dollar_brace": r"\$\{\s*[\w.\- ]{1,80}\s*\}",
    "hash_brace": r"#\{\s*[\w.\- ]{1,80}\s*\}",
    "percent_tag": r"<%[=\-#]?[^%<>\n]{1,120}%>|\{%[^%{}\n]{1,120}%\}",
    "double_bracket": r"\[\[\s*" + _NAME + r"\s*\]\]",
    "double_angle": r"<<\s*" + _NAME + r"\s*>>",
    "guillemets": r"«\s*(?:[A-Z][A-Z0-9_.]+|[A-Za-z]+[_.][\w.]+|(?:[a-z]+|[A-Z][a-z]+)(?: [A-Za-z]+){0,3})\s*»",
    "double_at": r"@@\s*" + _NAME + r"\s*@@",
    "percent": r"%[A-Z][A-Z0-9_]{1,60}%|%\([a-z_]+\)[sd]",
    "double_underscore": r"(?<![\w.])__[A-Z][A-Z0-9_ ]*?__(?!\w)",
    "numbered_brace": r"(?<![\\\w])\{\d{1,2}\}",
    "named_brace": r"(?<![\\\w$#{])\{[a-z]+(?:[_.][a-z]+)+\}",
    "instruction": r"(?i:(?:\[\s*" + _FILL_IN + r"(?:[^\[\]]|\[[^\[\]]*\])++\]|<\s*" + _FILL_IN + r"[^<>]++>|\(\s*" + _FILL_IN + r"(?:[^()]|\([^()]*\))++\)|[\[(<]\s*" + _FILL_IN + r"[^\])>\n]{1,60}[\])>]))",
    "to_come": r"(?i:[\[<(]\s*(?:[\w ]{0,40}\b)?(?:to come|tbd|tbc|to be (?:confirmed|determined|completed|inserted|supplied|advised)|fill in|placeholder)\s*[\]>)])",
    "bullet": r"\[\s*[●•_*…]+\s*\]|\[\s*\.{2,}\s*\]",
    "masked_date": r"\b(?:XX|DD|MM)/(?:XX|MM|DD)/(?:20XX|XXXX|YYYY|19XX)(?!\w)",
}
_PLACEHOLDER = re.compile("|".join(f"(?P<{k}>{v})" for k, v in PLACEHOLDERS.items()))
#: What a placeholder begins with; such places alone are tried.
_OPENS = re.compile(r"[{$#<%\[«@_(XDM]")
_CODE = re.compile(r"```.*?```|~~~.*?~~~|`[^`\n]+`|<(code|pre)>.*?</\1>", re.S)
_INDENTED = re.compile(r"(?m)(?:^(?: {4}|\t).*\S.*$\n?)+")
#: What only code says; a clause is indented too. Looked for with the placeholders cut out.
_CODE_LINE = re.compile(r"""(?mx) </?[a-z][\w-]*(?:\s[^<>]*)?/?> | [{}]\s*$ | \w\([^()\n]*\)\s*;?\s*$ | ^\s*[a-z_][\w.]*\s*(?:=|\+=|:=)\s* | ^\s*(?:def|function|class)\s+\w+\s*[(:{]
 | ^\s*(?:var|let|const)\s+\w+\s*= | ^\s*(?:import\s+[\w.]+\s*;?$|from\s+[\w.]+\s+import\s|\#include\b|\$\s+\w|SELECT\s.+\sFROM\s) | [=!]=|=>|->|&&|\|\| | ^\s*"?[\w-]+"?:\s*"[^"\n]*",?\s*$""")
_EXPLAINS = re.compile(r"(?i)\b(placeholders?|template (?:syntax|variable|language|engine)s?|merge fields?|escap\w+|syntax|tutorial|example)\b")
#: Words that only speak of templates. Fixed values.
_MANUAL = re.compile(r"(?i)\b(?:placeholders?|template (?:syntax|variable|language|engine|tag|file)s?|(?:our|the|these|use|using|e-?mail|document|letter) templates?|merge (?:fields?|tags?)|mail merge|jinja2?|mustache|handlebars|thymeleaf|freemarker|erb|moustache tags?|curly brac(?:es|kets)|double braces|syntax|tutorial|(?:is|are|gets?) (?:replaced|substituted|rendered|interpolated|expanded)|renders? as|escap(?:e|ed|ing)|vorlagenvariablen?|platzhalter|espaces? réservés?|marcador(?:es)? de posición)\b")
MANUAL_SHARE, MANUAL_WORDS = 0.02, 3
#: How a sentence tells of a placeholder: before it, and after it. Fixed values.
_TOLD_BEFORE = re.compile(r"(?i)(?:\b(?:is|are|be) (?:written|typed|spelled|marked|denoted|shown)(?: as| like| with| by)?|\b(?:write|type|put|use|using|replaces?|such as|like|called|named|say|schreiben sie|écrivez|escriba)(?: the (?:tag|token|field|variable))?)\s*[:\"'“‘]?\s*$")
_TOLD_AFTER = re.compile(r"(?i)^[\"'”’]?\s*(?:where(?:ver)?\b|in place of\b|to (?:show|print|mark|insert|stand|get)\b|(?:is|are|gets?|will be) (?:replaced|substituted|filled|rendered|expanded|written)\b|stands? for\b|expands? to\b|renders?\b|becomes?\b|for the (?:name|date|amount|value) (?:of|to)\b)")
_STOPS = re.compile(r"[.!?]\s|\n")
_QUOTED = re.compile(r"[\"'“‘‹]\s*$")

#: What error pages and their programs say. Fixed values.
ERRORS = r"""(?ix)
 \b(?:http\s*)?(?:error|erreur|fehler|errore|erro)\s*(?:code\s*)?:?\s*[1-5]\d\d\b | \b[45]\d\d\s+(?:bad|not|forbidden|internal|service|gateway|unauthori[sz]ed|too\s+many|request|server|error|method|gone|page)
 | \b(?:internal\s+server\s+error|bad\s+gateway|bad\s+request|gateway\s+time-?out|service\s+(?:temporarily\s+)?unavailable|access\s+(?:is\s+)?denied|page\s+(?:not\s+found|unavailable)|request\s+blocked|session\s+(?:has\s+)?(?:expired|timed\s+out)|server\s+error\s+in)\b
 | \bsession\s+has\s+timed\s+out\b | \b(?:requested|page|file|filing|document|exhibit|resource|url|link|address)\b.{0,50}\b(?:could\s+not\s+be\s+(?:found|displayed|loaded|opened)|cannot\s+be\s+(?:displayed|found|opened|loaded)|was\s+not\s+found|does\s+not\s+exist|no\s+longer\s+exists?|has\s+expired|has\s+expired\s+or\s+was\s+moved|expired\s+or\s+was\s+moved)
 | \bnothing\s+(?:lives|exists|was\s+found|is)\s+at\s+this\s+address\b | \b(?:unexpected|unknown|fatal)\s+error\s+occurred\b | \b(?:do\s+not|don't)\s+have\s+permission\s+to\s+(?:open|view|access)\b
 | \b(?:temporarily\s+)?unable\s+to\s+handle\s+your\s+request\b | \bconnection\s+to\s+.{1,40}\bwas\s+(?:reset|refused|lost|closed)\b | \btimeout\s+while\b | \btimed?\s*out\s+(?:while|waiting|contacting)\b
 | \btoo\s+many\s+requests\b | \btry\s+again\s+(?:in|later)\b | \bsign\s+in\s+again\b | \b(?:scheduled\s+work\s+is\s+under\s+way|down\s+for\s+(?:scheduled\s+)?maintenance|under\s+maintenance)\b | ^(?:the\s+)?(?:archive|site|service|page)\s+returns?\s+at\b
 | \breturned\s+an\s+invalid\s+response\b | \bquery\s+failed\b | \brelation\s+\S+\s+does\s+not\s+exist\b | \b(?:traceback|stack\s+trace|uncaught\s+exception|nullpointerexception|segmentation\s+fault|core\s+dumped)\b | \b[A-Z]?\w*(?:Error|Exception)\b\s*(?::|['"(]|$) | \bobject\s+reference\s+not\s+set\b
 | \bin\s+\w+\(\)\s*$ | \{\s*"(?:status|error|code|message)"\s*: | "error"\s*: | </?error>|</?code> | \boops\s*! | \bsomething\s+went\s+wrong\b
 | \bseite\s+nicht\s+gefunden\b | \bzugriff\s+verweigert\b | \bangeforderte\s+(?:datei|seite)\b.{0,30}\b(?:existiert|gefunden) | \bpage\s+introuvable\b | \b(?:document|page|fichier)\s+demand[ée]e?\s+est\s+introuvable\b | \bacc[èe]s\s+refus[ée]\b | \bp[áa]gina\s+no\s+encontrada\b | \bacceso\s+denegado\b | \bpagina\s+non\s+trovata\b
"""
NOTICES = r"""(?ix)
 \b(?:enable|activate|turn\s+on|allow|require[sd]?|needs?|without|disabled?|unsupported|support|off|blocked|aktivieren|activer?|active|activez|attivare|habilite|execute|ejecut\w+|ex[ée]cute)\b.{0,40}\b(?:java\s?script|js|scripts?|scripting|active\s+content)\b
 | \b(?:java\s?script|js|scripts?|scripting)\b.{0,60}\b(?:enabled?|activate|turned?\s+on|switched\s+off|require[sd]?|needs?|disabled|blocked|off|necessary|n[ée]cessaires|aktivieren|attivare|activar)\b
 | \bnoscript\b | \bjs\s+off\b | \bturn\s+it\s+on\s+and\s+reload\b | \ballow\s+(?:scripts|active\s+content)\b | \breader\s+mode\s+unavailable\b | \bthe\s+exhibit\s+list\s+needs\s+it\b | \bcontent\s+loads\s+dynamically\b | \bn'ex[ée]cute\s+pas\s+les\s+scripts\b
"""
FILLER = r"""(?ix)
 \b(?:sample|dummy|example|placeholder|test)\s+(?:paragraph|text|copy|clause|content|sentence)\b. | \bdummy\s+(?:clause|text|copy|paragraph|content)\b | \b(?:text|copy|content|title|description|summary|name|heading)\s+goes\s+here\b | \bwill\s+appear\s+here\b | \b(?:body\s+copy|text|copy|content)\s+to\s+follow\b
 | \b(?:add|enter|type|write|insert|put|click)\s+(?:a|an|the|your|to|here|some)\b.{0,60}\b(?:description|text|here|box|title|summary|edit|paragraph)\b | \btest\s+test\s+test\b | \bbeispieltext\b | \bblindtext\b | \btexte\s+(?:d'exemple|de\s+remplissage)\b | \btexto\s+de\s+(?:ejemplo|relleno|prueba)\b | \blorem\s+ipsum\b | \bcoming\s+soon\b
"""
NAVIGATION = r"""(?ix)
 ^(?:home|menu|search|login|log\s+in|help|contact|about|cookies?|privacy|terms|filings|exhibits|next|previous|back|top|sitemap|share|print)(?:\s*[|>/·•-]?\s+(?:home|menu|search|login|help|contact|about|cookies?|privacy|terms|filings|exhibits|next|previous|back|top|sitemap|share|print))*\s*$
 | ^skip\s+to\s+(?:main\s+)?content | ^return\s+to\s+the\s+\w+(?:\s+page)? | ^(?:contact|call|email)\s+support\b | ^(?:reference|request|incident|ray|error|trace)\s*(?:id|no|number)?\s*[:#]?\s*[0-9a-f-]{4,}\.?$ | ^(?:reference|request|incident|trace)\s+id:?$ | ^[0-9a-f]{6,}$ | ^copyright\b | ^© | ^checking\s+your\s+(?:connection|browser)\b
"""
_ERROR, _NOTICE, _FILL, _NAV = (re.compile(x) for x in (ERRORS, NOTICES, FILLER, NAVIGATION))
#: Words of the usual fillers: pseudo-Latin, keyboard runs, words for text. Fixed values.
_SOUP = frozenset(
    """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam
    quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat
    nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum
    asdf qwer qwerty zxcv jkl hjkl uiop yxcv wasd foo bar baz qux
    text texts words word copy body clause sample dummy placeholder filler blah
    absatz leer muster blindtext beispiel beispieltext platzhalter texte exemple vide modele texto ejemplo relleno prueba""".split()
)
_SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n+|(?<=:)\s+(?=[A-Z{\"])|(?<=Help)\s+|(?<=Terms)\s+|(?<=content)\s+(?=[A-Z])|(?<=page)\s+(?=[A-Z])")
_WORD = re.compile(r"[^\W\d_]+")
_NAV_INSIDE = re.compile(r"(?i)home \| \w+ \| \w+ \| \w+|cookies +privacy +terms|skip to main content|return to the search page|contact support if the problem persists\.?|checking your connection before continuing[.…]*|(?:reference|incident|request)(?: id:?)? [0-9a-f]{8}\b")
TITLE_WORDS = 10


def _is_code(text: str, start: int, block: str) -> bool:
    """Whether an indented block looks like code, or is shown by a line that speaks of placeholders."""
    lead = text[max(0, start - 300) : start].rstrip().rsplit("\n", 1)[-1]
    return bool((lead.endswith(":") and _EXPLAINS.search(lead)) or _CODE_LINE.search(_PLACEHOLDER.sub("", block)))


def _told(text: str, start: int, end: int) -> bool:
    """Whether the sentence around a placeholder tells how it is written or what becomes of it."""
    before = _STOPS.split(text[max(0, start - 300) : start])[-1]
    after = _STOPS.split(text[end : end + 300], maxsplit=1)[0]
    told = bool(_TOLD_BEFORE.search(before)) + bool(_TOLD_AFTER.search(after))
    return told == 2 or (told == 1 and bool(_MANUAL.search(before) or _MANUAL.search(after)))


def _is_manual(text: str) -> bool:
    """Whether words that only speak of templates are dense in ``text``, placeholders left out."""
    plain = _PLACEHOLDER.sub(" ", text)
    said = sum(1 for _ in _MANUAL.finditer(plain))
    return said >= MANUAL_WORDS and said >= MANUAL_SHARE * len(_WORD.findall(plain))


def placeholders(text: str) -> list[str]:
    """Kinds of the unfilled placeholders of ``text``, code and explanations discounted."""
    found, code, end, manual = [], None, 0, None
    for first in _OPENS.finditer(text):
        if first.start() < end or not (m := _PLACEHOLDER.match(text, first.start())):
            continue
        end = m.end()
        if code is None:
            code = [c.span() for c in _CODE.finditer(text)] + [c.span() for c in _INDENTED.finditer(text) if _is_code(text, c.start(), c.group())]
        if any(a <= m.start() < b for a, b in code):
            continue
        a, b = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        line = text[a : b if b >= 0 else len(text)]
        if (_QUOTED.search(text[max(0, m.start() - 2) : m.start()]) and _EXPLAINS.search(line)) or _told(text, m.start(), m.end()):
            continue
        manual = _is_manual(text) if manual is None else manual
        if manual:
            return []
        found.append(m.lastgroup)
    return found


def _parts(text: str) -> Iterator[str]:
    """The sentences of ``text``, one by one, navigation inside them cut out."""
    start = 0
    for m in _SENTENCE.finditer(text):
        yield from _NAV_INSIDE.split(text[start : m.start()])
        start = m.end()
    yield from _NAV_INSIDE.split(text[start:])


def _kind(sentence: str) -> str:
    s = sentence.strip()
    low = [w.lower() for w in _WORD.findall(s)]
    if not low:
        return "blank"
    if _NAV.search(s):
        return "navigation"
    if len(low) >= 3 and sum(set(w) <= {"x"} for w in low) >= 0.8 * len(low):
        return "filler"
    soup = [w in _SOUP or (len(w) > 1 and set(w) == {"x"}) for w in low]
    if len(low) >= 3 and sum(soup) >= 0.8 * len(low):
        return "filler"
    title = next((i for i, x in enumerate(soup) if x), len(low))
    if title <= TITLE_WORDS and len(low) - title >= 4 and all(soup[title:]):
        return "filler"
    for kind, grammar in (("filler", _FILL), ("notice", _NOTICE), ("error", _ERROR)):
        if grammar.search(s):
            return kind
    return "content"


def diagnose(text: str | None) -> str | None:
    """``placeholder``, ``filler``, ``error``, ``notice``, or None for a sound record.

    Null, empty and blank texts hold no residue and are sound here.
    """
    if not text or text.isspace():
        return None
    if placeholders(text):
        return "placeholder"
    kinds: dict[str, int] = {}
    titles = 0
    for part in _parts(text):
        kind = _kind(part)
        if kind == "content":
            n, ends = len(_WORD.findall(part)), part.rstrip()[-1:] in ".!?;,"
            if n > TITLE_WORDS or ends or (titles and n > 3) or titles > 2:
                return None
            titles += 1
        elif kind not in ("blank", "navigation"):
            kinds[kind] = kinds.get(kind, 0) + len(part)
    return max(kinds, key=lambda k: kinds[k]) if kinds else None


def residue(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind) once for each record that is residue.

    Repeated deliveries of an id collapse; an id is residue if any of its texts is.
    Null ids are kept as one. Every text but null is read whole, however long: the
    grammars are too many for a mark in the JVM that none of them could slip past.
    """
    rows = documents.select(F.col(id_col).alias("rid"), F.col(text_col).alias("rtext")).where(F.col("rtext").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[["rid"]].assign(kind=[diagnose(t) for t in pdf["rtext"]])
            yield out[out["kind"].notna()]

    kind = rows.schema["rid"].dataType.simpleString()
    found = rows.transform(shipped).mapInPandas(run, f"rid {kind}, kind string")
    return found.groupBy("rid").agg(F.max("kind").alias("kind")).select(F.col("rid").alias(id_col), "kind")
