"""Broken prompt and response pairs: a linear classifier over hashed n-grams.

Each pair gets hashed word and character n-grams of the answer and features of the pair
(overlap, how the answer ends, script, and how likely the answer's letters are in the
question's language, by letter models learned from the corpus). One logistic model per
defect is trained on sound pairs and on synthetically emptied, truncated, refused, copied
and language-swapped responses. Its scores are calibrated to log-odds on held-out
synthetic pairs, and the defect with the highest log-odds over the threshold is the pair's.

Training reads at most MAX_SOUND sound pairs and MAX_FOREIGN clauses, taken in hash order;
that bound is the size of a training sample only. Every pair is scored.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexloom.runtime import shipped

DEFECTS = ("empty", "truncated", "refusal", "copy", "language")
MAX_SOUND, MAX_FOREIGN = 1500, 800
DIM = 1 << 14
_PAIR_ONLY = [DEFECTS.index("copy"), DEFECTS.index("language")]
EPOCHS, RATE, L2 = 6, 0.5, 1e-6

#: Function words by language, accents removed. Fixed values.
FUNCTION_WORDS = {
    "en": "the of to and in is it its that which for on by with from not no be are was were has have may must shall who what when how does did if this these each any only none under before after than yes as at or an",
    "de": "der die das und ist nicht den dem des von zu ein eine einer eines fur fuer nach mit auf wenn soweit bis wird werden hat darf mussen muessen muss welche welcher wer gilt sich sind vor dass bei uber ueber zum zur kein keine so nur dann danach seit auch innerhalb spatestens hochstens hoechstens die ich leider an bitte",
    "fr": "de a le la les des du un une et est qui que dans pour par sur au aux ne pas ce cette se sont avec plus avant apres il elle car toute tout il faut sous lorsque tenus ou je vous nous doit peut l d en",
    "es": "de a el la los las del un una y es que en para por con se no su al lo mas antes despues si sera puede debe como cual quien hasta desde segun conforme dentro solo entre tras esta este quedan ha sus",
    "it": "a secondo vale oppure anche dopo prima quando sara hanno loro questo questa il lo la i gli le di del della dei delle un una e che in per con non si al alla entro piu deve puo sono da dal ogni perche nel nella ai occorre",
    "pt": "ha sem apos antes isso esta seja sera foi ela ele termos acordo vale o a os as de do da dos das um uma e que em para por com nao se ao no na nos nas mais ate deve pode sao qualquer pois ultrapassa prazo quando desde",
}
_FW = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_LANGS = tuple(_FW)
_IN = {w: [i for i, k in enumerate(_LANGS) if w in _FW[k]] for w in sorted(frozenset().union(*_FW.values()))}
_ALL_FW = frozenset().union(*_FW.values()) - frozenset("i l d y".split())
#: Words that a finished English, German, French or Spanish sentence doesn't end with.
_DANGLING = frozenset(
    "the of to and in by with from under before for on at or an a that which as than if its each any per not be is are was has have may must shall will would can cannot could should more less up only since so but into until against including provided once when while it he she they who whose does do keeps sets covers left moved fixes caps "
    "der die das und von zu den dem des ein eine nach mit auf wenn bis fur fuer hat darf ist le la les des du un une et de que qui dans pour par sur au aux el los las del y en por con se al".split()
)
_WORD = re.compile(r"[^\W_]+(?:[.,'’][^\W_]+)*")
_ASCII, _DIGIT, _NEW_SENTENCE = re.compile(r"[a-z]+"), re.compile(r"\d"), re.compile(r"[.!?:]")
_QUOTE = re.compile(r"“[^”]*”|„[^“]*“|«[^»]*»|\"[^\"]*\"")
_ENUMERATOR = re.compile(r"\([a-z]{1,4}\)")
_STANDIN = re.compile(r"(?i)^[\W_]*(?:n/?a|none|null|nil|tbd|tbc|todo|nan|undefined|blank|empty|answer|response|reply|not applicable|pending|missing|unavailable|unanswered|blank answer|(?:no|not)\s+(?:answer|response|reply|available|provided|answered|given)(?:\s+(?:available|provided|given|yet|was given|found))?|k\.?\s?a\.?|s/?o|\W)*[\W_]*$")
_STANDIN_SOUND = re.compile(r"(?i)^\W*(?:none|nil)\b.*\w{2,}|^(?:none|nil)\.?$")
_SENTENCE_END = re.compile(r"[.!?][\"”’')\]]*\s*$")
_CUT_MARK = re.compile(r"(?:\.\.\.|…|\[(?:truncated|cut|\.\.\.)\]|\[…\])\s*$", re.I)
_SELF = re.compile(r"\bI(?=['’\s])|(?i:\b(?:we|my|ich|mich|mir|wir|uns|je|nous|puedo|podemos|prefiero|quiero|estoy|tengo|nosotros|pronuncio|niego|posso|prefiro|preferisco|lamento|désolé|lo siento|perdone|bitte fragen|consulte|pregunte|demandez|veuillez|assistant|ask(?:ed)?|consult\w*|comment|guidelines)\b)")


def fold(text: str) -> str:
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def language_scores(text: str) -> np.ndarray:
    """Function words of each language in ``text``, quotations left out."""
    # Letters of enumerations are no words.
    out = np.zeros(len(_LANGS))
    for w in _ASCII.findall(_ENUMERATOR.sub(" ", fold(_QUOTE.sub(" ", text)))):
        if own := _IN.get(w):
            for i in own:
                out[i] += 1.0 / len(own)
    return out


#: Scripts by their letters; a text's script is the one that most of its letters are of.
_SCRIPTS = {"latin": r"[A-Za-z\u00aa-\u024f\u1e00-\u1eff]", "greek": r"[\u0370-\u03ff]", "cyrillic": r"[\u0400-\u052f]", "semitic": r"[\u0590-\u06ff]", "indic": r"[\u0900-\u0dff]", "thai": r"[\u0e00-\u0e7f]", "han": r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]"}
_SCRIPT_RE = {k: re.compile(v) for k, v in _SCRIPTS.items()}


def script(text: str) -> str:
    if text.isascii():
        return "latin"
    n = {k: len(r.findall(text)) for k, r in _SCRIPT_RE.items()}
    return max(n, key=lambda k: n[k]) if any(n.values()) else "latin"


#: Letters of plain words below which nothing is said of an answer's language.
_SAYS = 16


def spoken(text: str) -> str:
    """The words of ``text`` in small letters alone: no names, numbers or quotations."""
    return " ".join(w for w in _WORD.findall(_ENUMERATOR.sub(" ", _QUOTE.sub(" ", text))) if w.islower() and w.isalpha())


@dataclass
class Letters:
    """Letter models: the log-likelihood of each run of three letters in each language."""

    langs: tuple = ()
    table: dict = field(default_factory=dict)
    least: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Mean and spread of the likelihood of sound texts of each language.
    usual: dict = field(default_factory=dict)

    @classmethod
    def learn(cls, texts: list[tuple[str, str]]) -> Letters:
        """From (language, text) rows; a language needs some hundred letters to count."""
        by: dict[str, list[str]] = {}
        for lang, t in texts:
            by.setdefault(lang, []).append(spoken(t))
        by = {k: v for k, v in by.items() if sum(map(len, v)) >= 400}
        langs = tuple(sorted(by))
        counts = {k: Counter(g for t in by[k] for g in cls._grams(t)) for k in langs}
        every = sorted(set().union(*counts.values())) if langs else []
        total = {k: sum(counts[k].values()) for k in langs}
        floor = np.array([math.log(0.2 / (total[k] + 0.2 * (len(every) + 1))) for k in langs])
        table = {g: np.array([math.log((counts[k][g] + 0.2) / (total[k] + 0.2 * (len(every) + 1))) for k in langs], dtype=np.float32) for g in every}
        out = cls(langs, table, floor)
        for i, k in enumerate(langs):
            got = [float(out.likelihood(t)[i]) for t in by[k] if len(t) >= _SAYS]
            out.usual[k] = (float(np.mean(got)), max(0.15, float(np.std(got)))) if got else (0.0, 1.0)
        return out

    @staticmethod
    def _grams(t: str) -> Iterator[str]:
        t = f" {t} "
        return (t[i : i + 3] for i in range(len(t) - 2))

    def likelihood(self, plain: str) -> np.ndarray:
        get, least = self.table.get, self.least
        rows = [get(g, least) for g in self._grams(plain)]
        return np.add.reduce(rows) / len(rows)


@lru_cache(maxsize=20_000)
def _question(q: str) -> tuple[frozenset, np.ndarray, str]:
    return frozenset(_WORD.findall(fold(q))), language_scores(q), script(q)


@lru_cache(maxsize=100_000)
def _slot(gram: str) -> int:
    return zlib.crc32(gram.encode()) % DIM


DENSE = 47


def features(question: str | None, answer: str | None, letters: Letters | None = None) -> tuple[list[int], np.ndarray]:
    """Hashed slots of the answer's n-grams, and the dense pair features."""
    q, a = question or "", answer or ""
    body = a.strip()
    sq, lq, q_script = _question(q)
    raw = list(_WORD.finditer(body))
    at = [fold(r.group()) for r in raw]
    shape = [w if w.isalpha() else "0" if _DIGIT.search(w) else w for w in at]
    # Names carry no sign of a defect: capitals inside a sentence are masked.
    shape = ["N" if i and body[r.start()].isupper() and s not in _ALL_FW and not _NEW_SENTENCE.search(body, raw[i - 1].end(), r.start()) else s for i, (r, s) in enumerate(zip(raw, shape))]
    grams = {f"1 {w}" for w in shape} | {f"2 {x} {y}" for x, y in zip(shape, shape[1:])} | {f"3 {x} {y} {z}" for x, y, z in zip(shape, shape[1:], shape[2:])}
    grams |= {"s " + " ".join(shape[:k]) for k in (1, 2, 3)} | {"e " + " ".join(shape[-k:]) for k in (1, 2)}
    low = re.sub(r"\d+", "0", fold(body))
    grams |= {f"c {low[-k:]}" for k in (1, 2, 3, 4)}
    d = np.zeros(DENSE)
    sa = set(at)
    common = len(sq & sa)
    cover_q, cover_a = common / max(1, len(sq)), common / max(1, len(sa))
    n = len(at)
    ended, cut = bool(_SENTENCE_END.search(body)) and not _CUT_MARK.search(body), bool(_CUT_MARK.search(body)) and n > 0
    opened = body.count("(") > body.count(")") or body.count("“") > body.count("”") or body.count("[") > body.count("]")
    last = at[-1] if at else ""
    stand_in = bool(_STANDIN.match(body)) and not _STANDIN_SOUND.match(body)
    d[0] = 1
    d[1], d[2], d[3] = n == 0, stand_in, stand_in or n == 0
    d[4], d[5], d[6] = ended, cut, opened
    d[7], d[8] = last in _DANGLING and not ended, bool(re.search(r"[,;:\-–(]\s*$", body)) and n > 0
    d[9], d[10], d[11] = n <= 3, 3 < n <= 7, n > 7
    d[12] = not ended and n > 7
    d[13], d[14], d[15] = cover_q, cover_a, cover_q * cover_a
    d[16], d[17] = cover_q >= 0.75 and n > 4, cover_q >= 0.75 and cover_a >= 0.75 and n > 4
    la = language_scores(a)
    iq, ia = int(lq.argmax()) if lq.max() > 0 else 0, int(la.argmax())
    gap = la[ia] - la[iq] if la.max() > 0 else 0.0
    d[18], d[19], d[20], d[21] = ia != iq and gap >= 1, ia != iq and gap >= 2, min(gap, 6) / 6, gap / max(1.0, la.sum())
    d[22] = ia != iq and gap >= 1 and gap / max(1.0, la.sum()) > 0.25
    mine = len(_SELF.findall(body))
    d[23], d[24] = mine > 0, min(mine, 4) / 4
    words_only = [w for w in shape if w not in ("0", "N")]
    function = sum(w in _ALL_FW for w in words_only)
    d[25] = not ended and function >= 2
    d[26] = not ended and n > 3 and function >= 1
    d[27] = body.endswith("?") or body.endswith('?"')
    d[28] = "\n" in body and body.split("\n")[-1].lstrip().startswith(("-", "*", "•"))
    d[29] = len(body) == 0
    d[30] = not ended and n > 3 and last in _DANGLING
    d[31] = not ended and bool(re.search(r"(?i)\b(see|provided that|if|as defined in the|and|or)\W*$", body)) and n > 2
    d[32] = d[18] and ended
    d[33] = ended and n > 7
    d[34] = min(n, 60) / 60
    plain = [fold(w) for w in _WORD.findall(_QUOTE.sub(" ", body))]
    d[35] = not ended and len(plain) <= 6 and last not in _DANGLING and not cut and not d[8]
    d[36] = not ended and body.endswith(("”", ")")) and len(plain) <= 7
    d[38] = not ended and bool(re.search(r"[a-z)\d][.!?]\s+[A-Z§]", body)) and n > 2
    d[37] = not ended and sum(w in _ALL_FW and w not in ("and", "the", "from", "only", "yes", "no", "of") for w in plain) >= 1
    d[42] = script(body) != q_script and any(c.isalpha() for c in body)
    lang = _LANGS[iq]
    if letters is not None and lang in letters.usual and len(plain_words := spoken(body)) >= _SAYS:
        like = letters.likelihood(plain_words)
        i = letters.langs.index(lang)
        mean, spread = letters.usual[lang]
        # Short answers stray further from what is usual.
        z = (float(like[i]) - mean) / (spread * max(1.0, (60 / len(plain_words)) ** 0.5))
        best = float(np.delete(like, i).max()) if len(like) > 1 else float(like[i])
        d[39], d[40] = max(-6.0, min(2.0, z)) / 4, max(-2.0, min(2.0, best - float(like[i])))
        d[41], d[43] = best > like[i] and z < -1, z < -3
    d[44] = d[18] and d[41]
    # Without words of oneself a text in another language than English hardly refuses.
    d[45], d[46] = mine == 0 and la.max() > 0 and _LANGS[ia] != "en", mine == 0 and la.max() == 0 and n > 3
    return [_slot(g) for g in grams], d


@dataclass
class Model:
    weights: np.ndarray  # DIM x defects
    dense: np.ndarray  # DENSE x defects
    scale: np.ndarray  # calibration: log-odds = scale * score + shift
    shift: np.ndarray
    thresholds: np.ndarray  # in log-odds
    held_out: dict
    letters: Letters | None = None

    def log_odds(self, slots: list[int], d: np.ndarray) -> np.ndarray:
        grams = self.weights[slots].sum(axis=0) / max(1.0, len(slots)) ** 0.5 if slots else 0.0
        return (grams + d @ self.dense) * self.scale + self.shift

    def defect(self, question: str | None, answer: str | None) -> str | None:
        slots, d = features(question, answer, self.letters)
        m = self.log_odds(slots, d) - self.thresholds
        for k in np.argsort(-m):
            if m[k] <= 0:
                return None
            if _possible(DEFECTS[k], d):
                return DEFECTS[k]
        return None


def _possible(defect: str, d: np.ndarray) -> bool:
    """The exact check after the classifier: what a defect's definition requires."""
    if defect == "empty":
        return d[3] > 0
    if defect == "truncated":
        return d[4] == 0 and d[3] == 0
    if defect == "copy":
        return d[13] >= 0.6 and d[14] >= 0.6
    if defect == "language":
        return d[18] > 0 or d[42] > 0 or d[43] > 0 or d[41] > 0
    return d[3] == 0


# ---------------------------------------------------------------- synthetic pairs
#: Parts from which refusals are made. Fixed values.
_LEAD = ["", "I'm sorry, but ", "Unfortunately, ", "Regrettably, ", "Apologies - ", "As an assistant, ", "As an AI model, ", "After careful thought, ", "Thank you for the question. ", "Thanks for asking, but ", "Sorry, "]
_CORE = [
    "I cannot help with {t}", "I can't help with that", "I cannot answer this question", "I am not able to answer {t}", "I am unable to give an answer on {x}", "I must decline to answer {t}", "I must decline to comment on {x}", "I won't interpret {s} for you", "I will not speculate on {x}", "I'd rather not speculate on how {s} applies", "I would prefer not to say anything about {x}",
    "we are not in a position to respond", "we cannot comment on {x}", "this falls outside what I am permitted to discuss", "that is beyond what I may discuss", "it would not be appropriate for me to advise on the {x} agreement", "I can't provide legal conclusions about {x}", "I do not have enough information to answer {t}", "the supplied context gives me no basis to answer about {x}", "the context provided does not let me answer",
    "no answer can be offered here", "no answer can be given on {x}", "that is a legal judgment and I stay out of those", "my guidelines keep me from giving views on {x}", "my instructions do not allow me to discuss {x}", "I have been told to leave questions on {x} to its counsel", "I was asked not to discuss {x}",
    "insufficient context was supplied, hence no answer", "there is not enough context, so no answer", "no comment on {x}", "no comment", "not something I can go into", "not something I may discuss", "can't say", "cannot say", "I don't know", "I can't tell", "let us talk about something else instead", "let's change the subject", "better to put this to the {g}; I will leave it open", "please put this to the {g} instead", "ask your own lawyer about {s}", "ask a qualified attorney about {x}", "you should consult a lawyer about {x} rather than me",
]
#: Refusals by parts: who, does not, what, about what. Fixed values.
_WHO = ["I", "I", "I", "We", "This assistant", "The assistant", "The model", "The system", "Our team"]
_NOT = ["cannot", "can't", "won't", "will not", "could not", "am unable to", "am not able to", "am not allowed to", "am not permitted to", "decline to", "must decline to", "refuse to", "have to refuse to", "would rather not", "prefer not to", "choose not to", "am not going to", "am not in a position to", "do not feel comfortable to"]
_SAY = ["answer", "address", "discuss", "comment on", "help with", "assist with", "respond to", "touch", "go into", "speak to", "advise on", "weigh in on", "give an opinion on", "say anything about", "provide details on", "share anything on", "talk about", "interpret", "speculate on"]
_ABOUT = ["this", "that", "that one", "it", "this question", "your question", "such matters", "this topic", "this request", "{x}", "{s}", "the {x} agreement", "legal questions", "confidential terms"]
_LOOSE = [
    "{A} is off limits for me", "{A} is off the table", "{A} is outside my scope", "{A} is beyond what I can do", "{A} falls outside of my remit", "{A} is not something I can {v}", "{A} is nothing I may {v}", "that topic is off limits", "the model declines", "the assistant declines to reply", "request declined", "declined", "no can do", "nope, not going there", "nope, not going to {v} that one",
    "not going to {v} {a}", "not able to {v} {a}", "unable to {v} {a}", "cannot {v} {a}", "can't {v} {a}", "won't {v} {a}", "I'll pass on this one", "I will have to pass", "pass", "I'd prefer to skip {a}", "please ask somebody else about {a}", "someone else should {v} {a}", "this is for counsel to decide, not for me", "my policy does not let me {v} {a}", "policy keeps me from answering", "there is nothing I can tell you about {a}", "I have no answer for you", "you will not get an answer from me on {a}", "sorry, no", "sorry, but no", "let me stop you there; I do not {v} {a}",
    "that request is something I have to turn down", "I turn this one down", "ask me something else", "I do not know the answer to {a}", "it is not possible for me to {v} {a}", "I am afraid I can't {v} {a}", "that is not for me to say", "it isn't my place to {v} {a}",
]
#: Sound sentences that deny, decline or apologise about the matter itself. Fixed values.
_DENIES = [
    "The Borrower cannot {l} {m} before {d}.", "The Borrower is unable to {l} {m} once {s} applies.", "{y} must decline any drawing above {m} under {s}.", "{y} may refuse to {l} until {d}.", "No consent of {y} is needed to {l} {m}.", "I cannot find a later change of {s}.", "We found no amendment that touches {s}.", "The Agent will not {l} without the consent of {y}.", "{x} is not allowed to {l} more than {m}.", "Nobody can {l} {m} after {d}; {s} forbids it.", "That is not so: {s} was never changed.", "There is no such covenant; {s} covers only {m}.", "Sorry for the confusion: {s} sets {m}.", "{s} does not say who may {l}; the pricing grid does.", "The question assumes too much, since {y} never had to {l}.", "It is not possible to {l} under {s} before {d}.",
]
_LEGAL = ["pay", "reborrow", "prepay", "transfer", "assign", "withdraw", "amend", "release", "draw", "set off", "distribute"]
_TAIL = ["", "", "", " Please consult qualified counsel.", " Let me know if you have another question.", " I hope you understand."]
_JOIN = ["", "", ", as it may involve confidential terms", "; kindly ask the {g}", " because of my guidelines"]
_FOREIGN_REFUSALS = {
    "de": ["Ich möchte zu {x} nichts sagen.", "Das kann ich nicht beurteilen.", "Darüber spreche ich nicht.", "Diese Auskunft darf ich nicht erteilen.", "Ich bin nicht befugt, mich zu {x} zu äußern.", "Tut mir leid, darauf habe ich keine Antwort.", "Wir können Ihnen hierzu keine Antwort geben.", "Hierzu nehme ich keine Stellung.", "Ich lehne es ab, das auszulegen.", "Dazu sage ich lieber nichts.", "Bitte fragen Sie jemand anderen; ich helfe damit nicht weiter.", "Dazu kann ich leider keine Auskunft geben.", "Ich darf diese Frage zu {x} nicht beantworten.", "Bitte wenden Sie sich an einen Anwalt; ich antworte darauf nicht.", "Leider kann ich diese Frage nicht beantworten.", "Dazu möchte ich mich nicht äußern.", "Es tut mir leid, dabei kann ich nicht helfen."],
    "es": ["No quiero decir nada sobre {x}.", "De eso no hablo.", "No estoy autorizado a comentar {x}.", "No tengo respuesta para eso.", "No podemos darle una respuesta.", "Me niego a interpretar esa cláusula.", "Mejor pregunte a otra persona; yo no puedo ayudarle.", "Sobre esto no me pronuncio.", "Perdone, pero no puedo contestar.", "Lo siento, no puedo responder a esa pregunta.", "Prefiero no contestar; consulte a un abogado.", "No me es posible opinar sobre {x}.", "Lamentablemente no puedo ayudar con eso.", "No puedo dar una respuesta sobre {x}."],
    "it": ["Mi dispiace, non posso rispondere a questa domanda.", "Preferisco non esprimermi su {x}.", "Non sono autorizzato a parlarne."],
    "pt": ["Lamento, não posso responder a essa pergunta.", "Prefiro não comentar {x}.", "Não estou autorizado a falar sobre isso."],
    "fr": ["Je ne souhaite rien dire sur {x}.", "Je n'ai pas de réponse à vous donner.", "Nous ne pouvons pas vous répondre.", "Je refuse d'interpréter cette clause.", "Demandez à quelqu'un d'autre ; je ne peux pas vous aider.", "Désolé, je ne peux pas répondre à cette question.", "Il ne m'est pas possible de donner un avis sur {x}.", "Veuillez consulter un avocat ; je ne répondrai pas.", "Je préfère ne pas me prononcer sur {x}."],
}
#: Sound answers in the languages of the corpus, beside those that the sound pairs have. Fixed values.
_SOUND_FOREIGN = {
    "de": ["{x} muss {y} spätestens am {d} unterrichten, und alle Kreditgeber haben zuzustimmen.", "Ja, seit {d} gilt {s} auch für {x}.", "Nein, {s} erfasst nur {m}; mehr ist nicht zulässig.", "Zuständig ist der Agent, der vorher {y} anzuhören hat.", "Die Frist beträgt {n} Tage und beginnt mit dem Zugang der Mitteilung.", "Der Betrag von {m} bleibt unverändert, denn {s} wurde nicht geändert.", "Erst nach Zahlung von {m} darf {x} wieder darüber verfügen.", "Zustimmen müssen alle Bürgen, und zwar schriftlich vor dem {d}.", "Es gibt keine solche Grenze in {s}; maßgeblich ist allein die Preistabelle.", "{x} kann {m} nicht vor dem {d} abrufen, weil die Bedingungen fehlen."],
    "es": ["{x} debe informar a {y} a más tardar el {d}, y todos los acreedores han de aceptar.", "Sí, desde el {d} rige {s} también para {x}.", "No, {s} alcanza solo a {m}; nada más está permitido.", "Decide el agente, que antes debe oír a {y}.", "El plazo es de {n} días y corre desde la notificación.", "La suma de {m} no cambia, pues {s} quedó igual.", "Solo después de pagar {m} podrá {x} disponer de nuevo.", "Deben firmar todos los garantes antes del {d}.", "No hay tal límite en {s}; manda solo la tabla de precios.", "{x} no puede retirar {m} antes del {d} porque faltan las condiciones.", "Prevalece {s}, ya que deroga lo que se le oponga."],
    "fr": ["{x} doit informer {y} au plus tard le {d}, et tous les prêteurs doivent accepter.", "Oui, depuis le {d}, {s} vaut aussi pour {x}.", "Non, {s} ne vise que {m} ; rien de plus n'est permis.", "L'agent décide après avoir entendu {y}.", "Le délai est de {n} jours à compter de la notification.", "Le montant de {m} ne change pas, car {s} est resté le même."],
}
#: Sentences in languages that no table has enough of. Fixed values.
_FURTHER = {
    "it": ["Secondo {s}, {x} non può versare più di {m} a {y}.", "La modifica vale dal {d} e riguarda anche la riserva.", "Il beneficiario deve rimborsare {m} entro il {d}.", "Ai sensi della clausola occorre il consenso dei finanziatori.", "Prevale {s}, perché esclude ogni altra disposizione.", "L'agente informa i creditori entro {n} giorni.", "Il margine aumenta quando il rapporto supera la soglia.", "È necessario l'accordo della maggioranza e il limite di {m} resta.", "Sono escluse le garanzie concesse prima del {d}.", "Nel caso di recesso la conferma è dovuta in {s}."],
    "pt": ["De acordo com {s}, {x} não pode pagar mais de {m} a {y}.", "A alteração vale desde {d} e abrange também a reserva.", "O mutuário deve reembolsar {m} até {d}.", "Nos termos da cláusula é necessário o consentimento dos credores.", "Prevalece {s}, pois exclui qualquer outra disposição.", "O agente informa os credores no prazo de {n} dias.", "A margem aumenta quando o índice passa do limite.", "É preciso o acordo da maioria e o teto de {m} mantém-se.", "Ficam excluídas as garantias dadas antes de {d}.", "Os fiadores respondem solidariamente até {m}."],
    "nl": ["Volgens {s} mag {x} niet meer dan {m} aan {y} betalen.", "De wijziging geldt sinds {d} en raakt ook de reserve.", "De agent licht de kredietgevers binnen {n} dagen in.", "De kredietnemer moet {m} terugbetalen voor {d}."],
    "sv": ["Enligt {s} får {x} inte betala mer än {m} till {y}.", "Ändringen gäller från {d} och omfattar även reserven.", "Agenten ska underrätta långivarna inom {n} dagar.", "Låntagaren måste återbetala {m} före {d}."],
    "pl": ["Zgodnie z {s} spółka {x} nie może zapłacić {y} więcej niż {m}.", "Zmiana obowiązuje od {d} i dotyczy także rezerwy.", "Agent zawiadamia kredytodawców w ciągu {n} dni."],
    "da": ["Ifølge {s} må {x} ikke betale mere end {m} til {y}.", "Ændringen gælder fra {d} og omfatter også reserven."],
    "ro": ["Conform {s}, {x} nu poate plăti mai mult de {m} către {y}.", "Modificarea este valabilă din {d} și privește și rezerva."],
    "ru": ["Согласно {s}, {x} не может выплатить более {m}.", "Изменение действует с {d} и касается также резерва.", "Агент уведомляет кредиторов в течение {n} дней."],
    "el": ["Σύμφωνα με το {s}, ο δανειολήπτης δεν μπορεί να πληρώσει περισσότερα από {m}."],
    "zh": ["根据{s}，借款人最多可支付{m}。", "该修订自{d}起生效。"], "ja": ["{s}により、借入人は{m}を超えて支払うことができない。"], "ar": ["لا يجوز للمقترض أن يدفع أكثر من {m} قبل {d}."],
    "fr": ["Selon {s}, {x} ne peut verser plus de {m} à {y}.", "La modification est en vigueur depuis le {d}.", "La clause {s} l'emporte sur toute autre disposition."],
    "de": ["Nach {s} darf {x} höchstens {m} an {y} zahlen.", "Die Änderung gilt seit dem {d} und betrifft auch die Rücklage.", "Die Bestimmung {s} geht jeder anderen Regelung vor."],
    "es": ["Conforme a {s}, {x} no puede pagar más de {m} a {y}.", "El cambio rige desde el {d} y afecta también a la reserva.", "La disposición {s} prevalece sobre cualquier otra."],
}
_EMPTY = ["", " ", "\n", "\xa0", "\t \n", "-", "--", "—", "–", ".", "...", "…", "?", "??", "n/a", "N/A", "n.a.", "NA", "null", "NULL", "none provided", "TBD", "tbd", "TBC", "[ ]", "[]", "{}", "()", "(blank)", "<blank>", "Answer:", "answer: ", "A:", "Response:", "(empty)", "(none)", "*", "_", "nan", "undefined", "[answer]"]
_DANGLES = [" and", " the", " (see", ", provided that", " or, if", " as defined in the", " -", "...", "…", " …[truncated]", "\n- the", "  ", " of", ",", " which", ", and"]
_SHORT = ["{m}", "{s}", "{m} ({s})", "{s} and the {i}", "{s} and the {i}, “mutatis mutandis”", "{s}, “pari passu”", "{i}", "{x}", "Only {x}", "Yes, from {d}", "Yes, since {d}", "No.", "Yes.", "No", "Yes", "None", "None of them.", "None of these.", "Neither.", "Both.", "Zero", "Nil", "{d}", "Until {d}", "On {d}", "Not before {d}.", "Two", "{x} alone", "{x} and {y}", "By {d}", "Never.", "{n} Business Days", "{n} days"]
_MONEY, _SECTION, _DATE = re.compile(r"\$[\d,]*\d"), re.compile(r"(?:Section |§)\d[\d.]*(?:\([a-z]\))*"), re.compile(r"\d{4}-\d\d-\d\d")
_ENTITY = re.compile(r"\b[A-Z][a-z]{4,}(?: [A-Z][a-z]{3,})?")
_INSTRUMENT = re.compile(r"\b(?:First|Second|Third|Fourth|Fifth|Closing|Side) (?:Amendment|Letter)\b")


def _pick(rng: random.Random, pattern: re.Pattern, *texts: str, default: str) -> str:
    found = [m.group(0) for t in texts for m in pattern.finditer(t)]
    return rng.choice(found) if found else default


def _slots_of(rng: random.Random, q: str, a: str) -> dict:
    return {
        "m": _pick(rng, _MONEY, a, q, default="$5,000,000"), "s": _pick(rng, _SECTION, a, q, default="Section 2.01"), "d": _pick(rng, _DATE, a, default="2019-05-06"),
        "x": _pick(rng, _ENTITY, q, default="this matter"), "y": _pick(rng, _ENTITY, a, default="the Agent"), "i": _pick(rng, _INSTRUMENT, a, q, default="First Amendment"),
        "g": rng.choice(["Administrative Agent", "Agent", "Borrower", "bank"]), "t": rng.choice(["this request", "this question", "that", "this"]), "n": rng.choice("2 3 5 10 15 30".split()),
    }


def _some(rng: random.Random, texts: list[str]) -> list[str]:
    return rng.sample(texts, min(len(texts), rng.choice((1, 1, 2))))


def fold_some(rng: random.Random, text: str) -> str:
    """``text``, at times without its accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)) if rng.random() < 0.3 else text


def _truncate(rng: random.Random, a: str) -> str | None:
    """``a`` broken off inside one of its sentences, at a word or inside one."""
    sentences = re.split(r"(?<=[.!?])\s+(?=[A-Z§“¿])", a.strip())
    k = rng.randrange(len(sentences))
    words = sentences[k].split()
    if len(words) < 4:
        return None
    cut = rng.randrange(2, len(words))
    head = " ".join([*sentences[:k], " ".join(words[:cut])])
    if rng.random() < 0.25 and len(words[cut]) > 4:
        head += " " + words[cut][: rng.randrange(2, len(words[cut]) - 1)]
    if rng.random() < 0.5:
        head = head.rstrip(" ,;") + rng.choice(_DANGLES)
    return None if _SENTENCE_END.search(head) and not _CUT_MARK.search(head) else head


def _copy(rng: random.Random, q: str) -> str:
    words = q.split()
    how = rng.randrange(8)
    if how == 0:
        return q.lower()
    if how == 1:
        return f'"{q}"'
    if how == 2:
        return f"{q}\n{q}"
    if how == 3:
        return re.sub(r"[,.:;]", "", q)
    if how == 4 and len(words) > 6:
        i = rng.randrange(len(words))
        return " ".join(words[:i] + words[i + 1 :])
    if how == 5:
        return rng.choice(["Question: ", "You asked: ", "Q: "]) + q
    if how == 6:
        return q.rstrip("?") + "."
    return q


def refusal(rng: random.Random, v: dict) -> str:
    """An English refusal put together from parts."""
    about = rng.choice(_ABOUT)
    if rng.random() < 0.5:
        who, does = rng.choice(_WHO), rng.choice(_NOT)
        if who != "I":
            does = does.replace("am ", "are " if who == "We" else "is ")
            does = does if who == "We" else {"decline to": "declines to", "refuse to": "refuses to", "prefer not to": "prefers not to", "choose not to": "chooses not to", "have to refuse to": "has to refuse to"}.get(does, does)
        text = f"{who} {does} {rng.choice(_SAY)} {about}"
    else:
        text = rng.choice(_LOOSE).replace("{v}", rng.choice(_SAY)).replace("{a}", about).replace("{A}", about)
    return text.format(**v)


def synthetic(sound: list[tuple[str, str]], foreign: list[tuple[str, str]], seed: int = 11) -> list[tuple[str, str, str | None]]:
    """(question, answer, defect) made from sound pairs and foreign (language, sentence)."""
    rng = random.Random(seed)
    lang = lambda t: _LANGS[int(language_scores(t).argmax())]
    by_lang: dict[str, list[str]] = {}
    for code, s in foreign:
        by_lang.setdefault(code, []).append(s)
    clauses = {k: list(x) for k, x in by_lang.items()}
    for _, a in sound:
        by_lang.setdefault(lang(a), []).append(a)
    out: list[tuple[str, str, str | None]] = []
    # Few sound pairs are used several times, each time with other parts.
    for q, a in sound * max(1, min(8, 1200 // max(1, len(sound)))):
        v, ql = _slots_of(rng, q, a), lang(q)
        out.append((q, a, None))
        for _ in range(3):
            out.append((q, rng.choice(_SHORT).format(**v), None))
        for _ in range(2):
            if cut := _truncate(rng, a):
                out.append((q, cut, "truncated"))
        core = rng.choice(_CORE).format(**v) + rng.choice(_JOIN).format(**v)
        lead = rng.choice(_LEAD) if rng.random() < 0.75 else ""
        if not lead or lead.endswith(". "):
            core = core[0].upper() + core[1:]
        out.append((q, (lead + core + "." + rng.choice(_TAIL)) if ql == "en" else rng.choice(_FOREIGN_REFUSALS[ql]).format(**v), "refusal"))
        for _ in range(2):
            made = (rng.choice(_LEAD) if rng.random() < 0.3 else "") + refusal(rng, v)
            out.append((q, made[:1].upper() + made[1:] + rng.choice([".", ".", "", "!"]) + rng.choice(_TAIL), "refusal"))
        said = " ".join(t.format(**v, l=rng.choice(_LEGAL)) for t in rng.sample(_DENIES, rng.choice((1, 1, 2))))
        if ql == "en":
            out.append((q, said, None))
        elif clauses.get(ql):
            # Sound answers in other languages are few; clauses of the corpus stand for more.
            out += [(q, c, None) for c in rng.sample(clauses[ql], min(4, len(clauses[ql])))]
        if ql in _SOUND_FOREIGN:
            out += [(q, t.format(**v), None) for t in rng.sample(_SOUND_FOREIGN[ql], 5)]
        elif rng.random() < 0.2:
            k = rng.choice(list(_SOUND_FOREIGN))
            out.append((q, rng.choice(_SOUND_FOREIGN[k]).format(**v), "language"))
        if rng.random() < 0.3:
            short = rng.choice([c for c in _CORE if len(c) < 30]).format(**v)
            out.append((q, short[0].upper() + short[1:] + ".", "refusal"))
        if rng.random() < 0.15:
            out.append((q, rng.choice(_FOREIGN_REFUSALS[rng.choice(list(_FOREIGN_REFUSALS))]).format(**v), "refusal"))
        out.append((q, _copy(rng, q), "copy"))
        others = [k for k in by_lang if k != ql and by_lang[k]]
        if others:
            out.append((q, rng.choice(by_lang[rng.choice(others)]), "language"))
        if ql != "en" and by_lang.get("en"):
            # English is the commonest answer to a question in another language.
            out += [(q, rng.choice(by_lang["en"]), "language") for _ in range(4)]
        further = [k for k in _FURTHER if k != ql]
        out.append((q, " ".join(fold_some(rng, t.format(**v)) for t in _some(rng, _FURTHER[rng.choice(further)])), "language"))
        # A sound answer stays sound with a further sound sentence after it.
        if own := by_lang.get(ql):
            out.append((q, a + " " + rng.choice(own), None))
            if extra := clauses.get(ql):
                out.append((q, a + " " + rng.choice(extra), None))
        if rng.random() < 0.25:
            out.append((q, rng.choice(_EMPTY), "empty"))
    return out


def _calibrate(score: np.ndarray, hit: np.ndarray) -> tuple[float, float]:
    """(scale, shift) that turn scores into log-odds, by logistic regression on one number."""
    w, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(w * score + b, -30, 30)))
        g, v = p - hit, np.maximum(p * (1 - p), 1e-9)
        # Newton's step with a small pull to the scores as they are.
        h = np.array([[(v * score * score).sum() + 1, (v * score).sum()], [(v * score).sum(), v.sum() + 1]])
        step = np.linalg.solve(h, [(g * score).sum() + (w - 1), g.sum() + b])
        w, b = max(0.05, w - float(np.clip(step[0], -1, 1))), b - float(np.clip(step[1], -1, 1))
    return w, b


def train(pairs: list[tuple[str, str, str | None]], seed: int = 5, letters: Letters | None = None) -> Model:
    """Logistic regression per defect by AdaGrad; calibration and thresholds on held-out pairs."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(pairs))
    feats = [features(q, a, letters) for q, a, _ in pairs]
    y = np.array([[lab == k for k in DEFECTS] for _, _, lab in pairs], dtype=float)
    test, fit = order[: len(order) // 5], order[len(order) // 5 :]
    w, dn = np.zeros((DIM, len(DEFECTS))), np.zeros((DENSE, len(DEFECTS)))
    gw, gd = np.full_like(w, 1e-2), np.full_like(dn, 1e-2)

    def scores(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        slots = np.concatenate([np.asarray(feats[i][0], dtype=int) for i in rows] or [np.zeros(0, int)])
        lens = np.array([len(feats[i][0]) for i in rows])
        owner, scale = np.repeat(np.arange(len(rows)), lens), 1 / np.sqrt(np.maximum(1, lens))
        s = np.zeros((len(rows), len(DEFECTS)))
        np.add.at(s, owner, w[slots] * scale[owner][:, None])
        dense = np.array([feats[i][1] for i in rows])
        return s + dense @ dn, slots, owner, scale

    for _ in range(EPOCHS):
        for start in range(0, len(fit), 256):
            rows = rng.permutation(fit)[:256] if start == 0 else fit[start : start + 256]
            s, slots, owner, scale = scores(rows)
            err = (1 / (1 + np.exp(-s)) - y[rows]) / len(rows)
            g = np.zeros_like(w)
            np.add.at(g, slots, err[owner] * scale[owner][:, None])
            g += L2 * w
            # Copying and language are properties of the pair, not of the answer's words.
            g[:, _PAIR_ONLY] = 0
            gdn = np.array([feats[i][1] for i in rows]).T @ err
            gw += g * g
            gd += gdn * gdn
            w -= RATE * g / np.sqrt(gw)
            dn -= RATE * gdn / np.sqrt(gd)
    s, *_ = scores(test)
    scale, shift, cuts = (np.zeros(len(DEFECTS)) for _ in range(3))
    report: dict[str, float] = {}
    for k, name in enumerate(DEFECTS):
        hit = y[test][:, k]
        scale[k], shift[k] = _calibrate(s[:, k], hit)
        odds = s[:, k] * scale[k] + shift[k]
        order_k = np.argsort(-odds)
        tp, n = np.cumsum(hit[order_k]), np.arange(1, len(odds) + 1)
        f1 = 2 * tp / (n + hit.sum()) if hit.sum() else np.zeros(len(odds))
        # Of the cuts with the best F1 the one nearest to even odds, halfway between two scores.
        ordered = np.append(odds[order_k], odds.min() - 1)
        best = np.nonzero(f1 >= f1.max() - 1e-12)[0] if len(f1) else np.zeros(0, int)
        halves = [(ordered[i] + ordered[i + 1]) / 2 for i in best]
        cuts[k] = float(np.clip(min(halves, key=abs), -1.0, 1.0)) if halves else 0.0
        tp_at, n_at = float(((odds > cuts[k]) * hit).sum()), float((odds > cuts[k]).sum())
        report[name] = round(2 * tp_at / max(1.0, n_at + hit.sum()), 4)
    as32 = lambda x: x.astype(np.float32)
    return Model(as32(w), as32(dn), as32(scale), as32(shift), as32(cuts), report, letters)


def fit_model(sound: DataFrame, foreign: DataFrame, max_sound: int = MAX_SOUND, max_foreign: int = MAX_FOREIGN) -> Model:
    """Train on ``sound`` (question, answer) and ``foreign`` (lang, text) rows.

    At most ``max_sound`` pairs and ``max_foreign`` texts are collected, those with the
    least hashes, so the sample is the same on every run and follows no table order. A
    threshold on the hash keeps all others from leaving their partitions.
    """

    def sample(rows: DataFrame, most: int, *cols: str) -> list:
        unit = F.shiftrightunsigned(F.xxhash64(*cols), 11) / float(1 << 53)
        keyed = rows.withColumn("_u", unit)
        n = keyed.count()
        # A tenth more than wanted on average, so that there are hardly ever too few.
        some = keyed.where(F.col("_u") < min(1.0, (1.1 * most + 200) / max(1, n))).distinct().collect()
        return sorted(some, key=lambda r: (r["_u"], *[str(r[c]) for c in cols]))[:most]

    s = sample(sound.where("length(trim(question)) > 0 AND length(trim(answer)) > 0").select("question", "answer"), max_sound, "question", "answer")
    f = sample(foreign.where("length(text) BETWEEN 40 AND 4000").select("lang", "text"), max_foreign, "lang", "text")
    return fit(([(r.question, r.answer) for r in s]), [(r.lang, r.text) for r in f])


#: Sound pairs for tables that have none.
_PLAIN_SOUND = [
    ("What does Section 2.01 of the Aron agreement require, and by when?", "Section 2.01 requires Aron to repay $4,000,000 by 2019-05-06. No later change is on record."),
    ("Who may release the funds that Belor has lodged with the Agent?", "Only the Agent may release them, and Belor has to be told five days before."),
    ("Welche Frist gilt für Aron nach Ziffer 3.04?", "Nach Ziffer 3.04 gilt eine Frist von zehn Tagen; sie beginnt mit der Mitteilung."),
    ("Hasta qué fecha puede Belor disponer del tramo?", "Belor puede disponer del tramo hasta el 6 de mayo; después se pierde el derecho."),
]


def fit(sound: list[tuple[str, str]], texts: list[tuple[str, str]]) -> Model:
    """The model from sound (question, answer) pairs and (language, text) rows.

    Without any sound pair a few of its own stand in, so that there is always a model.
    """
    sound = sound or _PLAIN_SOUND
    lang = lambda t: _LANGS[int(language_scores(t).argmax())]
    clauses = [(k, c) for k, t in texts for c in re.split(r"(?<=[.])\s+", t) if 30 < len(c) < 300 and c[-1] == "." and lang(c) == k]
    letters = Letters.learn(clauses + [(lang(a), a) for _, a in sound if language_scores(a).max() >= 2])
    return train(synthetic(sound, clauses), letters=letters)


def find_defects(pairs: DataFrame, model: Model, keys: list[str], question: str = "question", answer: str = "answer") -> DataFrame:
    """(keys, defect) once for each key of ``pairs`` that has a defect.

    Repeated deliveries collapse. A null answer is empty; a null question has no words
    and no language, so only the answer's own defects show.
    """
    rows = pairs.select(*keys, F.col(question).alias("_question"), F.col(answer).alias("_answer"))
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", defect string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [model.defect(q, a) for q, a in zip(pdf["_question"].where(pdf["_question"].notna(), None), pdf["_answer"].where(pdf["_answer"].notna(), None))]
            out = pdf[keys].assign(defect=found)
            yield out[out["defect"].notna()]

    return rows.transform(shipped).mapInPandas(run, schema).groupBy(*keys).agg(F.min("defect").alias("defect"))
