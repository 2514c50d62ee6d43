"""Problem 4: prompt and response pairs that are empty, cut off, refused, copied or in another language.

Method: responses are sorted by text and neighbours' common prefixes show shortened versions; spikes of length show limits, and the
end model of truncation.py weighs the rest. Rules for empty answers and copies follow, and models of languages and refusals that are
fitted on all of the data's own pairs: word lists and phrases are their seeds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.frames import plain
from millrace.llm import refusals
from millrace.llm.language import FEW, FUNCTION_WORDS, Profiles, clear, counts, grams_of, language, most, plain_words, script, support
from millrace.llm.truncation import judged, stripped
from millrace.session import cut, stored

#: What a longer version of the same text takes from a response's log-odds of being complete.
SHORTENED = 3.0
#: A further sentence of a refusal with more words than this needs to be told from an answer.
REFUSAL_WORDS = 14
#: The rules that a pair's own text shows, those that hold before others first.
ORDER = ("empty", "copy", "refusal", "language")
#: N-grams that a task holds at most before it gives their counts out.
HELD_GRAMS = 200_000
#: Keys (32 bytes) of texts that are shortened versions: up to so many are broadcast, more are joined by shuffle.
SMALL_KEYS = 100_000

# What stands for a missing answer.
STAND_INS = frozenset("none null nil nan na n/a tbd tba todo empty [empty] (empty) noanswer (noanswer) [noanswer] noresponse (none) [none] [null] undefined missing blank (blank) [blank] notavailable unanswered".split())
_TAG = re.compile(r"<[^<>]{0,200}>")
_INVISIBLE = re.compile(r"[\s​‌‍⁠﻿]+")

# Labels before a repeated prompt.
LABEL = re.compile(r"^\s*(?:[>\"“'*#\-]+\s*)?(?:(?:user|human|question|prompt|instruction|input|answer|response|assistant|output|q|a|frage|antwort|pregunta|respuesta|réponse|utilisateur|usuario|benutzer)\s*[:：\-]\s*)?", re.IGNORECASE)
_SENTENCE = re.compile(r"(?<=[.!?:])\s+|\n+")
_REST = re.compile(r"[\W_]+")

_I = r"\b(?:i|we|i'm|i am|me|my)\b"
_DO = r"(?:help|assist|answer|respond|reply|provide|comment|discuss|give|share|fulfil|fulfill|comply|support|do (?:that|this|so)|offer|go into|talk about|advise|judge)"
# How answers decline, by language.
REFUSALS = re.compile(
    "|".join(
        [
            rf"\b(?:i|we)\s+(?:\w+\s+)?(?:can't|cannot|can not|won't|will not|couldn't|could not|shouldn't|am not able to|'?m not able to|am unable to)\b[^.!?]*?\b{_DO}",
            rf"\b(?:unable|not able|not allowed|not permitted|not in a position) to\b[^.!?]*?\b{_DO}",
            rf"{_I}[^.!?]*?\b(?:have to|must|need to|will|would like to|'ll)\s+(?:decline|refuse|pass)",
            r"\b(?:this|that|your|the) (?:request|question) (?:can't|cannot|can not|won't|will not) be",
            r"\bnot (?:be )?appropriate for (?:me|us)\b|\b(?:questions?|requests?|things?) like (?:this|that|these)[^.!?]*?\bnot something (?:i|we)\b|\bis not something (?:i|we) (?:can|do|answer|discuss|help)",
            r"\boutside (?:of )?what (?:i|we) (?:can|may|do)\b|\bno answer from (?:me|us)\b|\bagainst (?:my|our) (?:guidelines|policy|policies|rules|instructions|principles)\b",
            r"\b(?:instructions|guidelines|rules|policies|policy) (?:do not|don't|does not|doesn't) (?:allow|permit|let)\b|\b(?:i|we) (?:don't|do not) (?:provide|give|offer|answer|discuss|share)\b",
            r"\bonly (?:a|an) (?:language model|assistant|ai)\b|\b(?:i|we)(?:'d| would) rather not\b|\bprefer not to\b|\bhave no way to judge\b",
            r"\b(?:kann|können|darf|dürfen|möchte|werde)\b[^.!?]*?\b(?:nicht|keine?n?)\b[^.!?]*?\b(?:helfen|beantworten|antworten|auskunft|geben|behandeln|kommentieren|äußern|sagen|besprechen|unterstützen)",
            r"\b(?:muss|möchte) ich[^.!?]*?\b(?:ablehnen|passen)|\blehne ich ab\b|\bkeine auskunft\b|\bbearbeite ich nicht\b|\b(?:richtlinien|vorgaben|regeln)\b[^.!?]*?\b(?:erlauben|gestatten|lassen|verbieten)\b|\bist mir nicht (?:möglich|erlaubt|gestattet)",
            r"\bje ne (?:peux|puis|saurais|dois) pas\b|\bne suis pas (?:en mesure|autorisée?)\b|\bm'est impossible\b|\bpréfère ne pas\b|\bdois (?:refuser|décliner)\b|\b(?:consignes|règles|directives) ne (?:me )?(?:le )?permettent\b|\bje (?:refuse|décline)\b",
            r"\bno (?:puedo|podemos|debo|me es posible|me está permitido|estoy (?:autorizad[oa]|en condiciones))\b|\bdebo (?:rechazar|negarme|declinar)\b|\b(?:normas|reglas|instrucciones|directrices) no me (?:dejan|permiten)\b|\bprefiero no\b|\bno respondo (?:a )?(?:esta|este|esa)",
        ]
    ),
    re.IGNORECASE,
)
# How a declining answer excuses itself, gives its reason or points elsewhere, by language.
DEFLECTIONS = re.compile(
    "|".join(
        [
            r"\b(?:sorry|apolog\w*|regret|unfortunately|thank you|thanks|i hope|hope you|hope that|for your (?:understanding|patience)|feel free)\b|\b(?:anything|something) else\b|\b(?:another|a different) (?:topic|question|subject)\b",
            r"\bplease (?:contact|ask|call|consult|reach|speak|talk|turn|write|see|visit|try|get in touch|understand|do not hesitate|refer)\b|\b(?:contact|consult|reach out|get in touch|speak|talk) (?:to|with|an?|the|your|our|someone|them|us)\b|\byou (?:can|could|may|might|should) (?:\w+ )?(?:ask|call|contact|reach|consult|turn|speak|talk|write)\b",
            r"\bif you (?:like|wish)\b|\bif you (?:want|need|have)\b[^.!?]*?\b(?:help|advice|questions?|support|information)\b|\b(?:happy|glad) to (?:help|assist|talk)\b|\b(?:support (?:desk|team|line)|help ?(?:line|desk)|hotline|colleague|someone (?:qualified|else)|qualified|professional)\b",
            r"\b(?:guidelines?|polic(?:y|ies)|my (?:role|training|knowledge|instructions|rules|operators?)|language model|as an (?:ai|assistant))\b|\b(?:i|we) (?:have no|do not have|don't have|lack|am not|are not|was not|cannot|can't|can not|must not|may not|am only|am just)\b",
            r"\b(?:leider|entschuldig\w*|tut mir leid|danke|hoffe|verständnis|richtlinien?|vorgaben|sprachmodell|beratungsstelle|fachleute|fachperson|kolleg\w*|etwas anderes|anderes thema)\b|\bbitte (?:wend\w*|frag\w*|ruf\w*|kontaktier\w*|schreib\w*|sprich|sprechen)\b|\bwende(?:n sie sich| dich)\b",
            r"\b(?:désolée?s?|merci|malheureusement|excus\w*|j'espère|compréhension|consignes|modèle de langage|collègue|professionnel\w*|autre (?:sujet|question|chose))\b|\b(?:veuillez|vous pouvez|tu peux) (?:contacter|consulter|demander|appeler|joindre|vous adresser)\b|\badressez-vous\b",
            r"\b(?:lo siento|lamento|gracias|lamentablemente|disculp\w*|espero|comprensión|normas|directrices|modelo de lenguaje|colega|profesional\w*|otr[oa] (?:tema|pregunta|cosa))\b|\b(?:por favor,? )?(?:contacte|consulte|llame|pregunte|póngase en contacto|puede (?:contactar|consultar|llamar|preguntar))\b",
        ]
    ),
    re.IGNORECASE,
)
_BUT = re.compile(r"(?:,\s*|\s+|^)(?:but|however|still|aber|jedoch|mais|cependant|pero|sin embargo)\s*,?\s+|;\s+", re.IGNORECASE)
# Numbers that say where or when to turn to, and prompts that ask for such.
_CONTACT = re.compile(r"\b\S+@\S+|\b(?:https?://|www\.)\S+|\+?\d(?:[\d()/\s-]*\d)?(?:[-/\s()]+\d{2,}){1,}")
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|mär|mai|okt|dez|avr|juin|juil|août|déc|ene|abr|ago|dic)[^\W\d_]*\.?"
_DATE = re.compile(rf"\b\d{{4}}-\d\d-\d\d\b|\b\d{{1,2}}[./]\d{{1,2}}[./]\d{{2,4}}\b|\b\d{{1,2}}(?:st|nd|rd|th|\.)?\s+(?:de\s+)?{_MONTH}(?:,?\s+(?:de\s+)?\d{{4}}\b)?|\b{_MONTH}\s+\d{{1,4}}\b(?:,?\s+\d{{4}}\b)?|\b\d{{1,2}}:\d\d\b", re.IGNORECASE)
_ASKED_FOR_ONE = re.compile(r"\b(?:when|what time|dates?|years?|phone|numbers?|how (?:many|much|long)|wann|datum|jahr|nummer|wie ?viele?|wie lange|quand|année|numéro|combien|cuándo|fecha|año|número|cuánt\w+)\b", re.IGNORECASE)
_LETTERS = re.compile(r"[^\W\d_]{4,}")
_NUMBER = re.compile(r"\d+")
_COMMON = frozenset(w for words in FUNCTION_WORDS.values() for w in words.split())

_ASKED_TO_DECLINE = re.compile(r"\b(?:refus\w*|declin\w*|turn(?:s|ing)? down|reject(?:s|ion|ing)?|apolog\w*|absag\w*|ablehn\w*|rechaz\w*|rechazo|refus)\b", re.IGNORECASE)
_TASK = re.compile(r"\b(?:write|draft|compose|formulate|note|letter|mail|email|message|schreib\w*|entw[ui]rf\w*|rédige\w*|écri\w*|escrib\w*|redact\w*)\b", re.IGNORECASE)

_CORRECTING = re.compile(r"\b(?:proofread\w*|correct\w*|spelling|typos?|grammar|mistakes?|korrigier\w*|rechtschreib\w*|corrig\w*|orthograph\w*|ortograf\w*)\b", re.IGNORECASE)

# Names of the four languages in each other; names of others come from language_names().
LANGUAGE_NAMES = {
    "en": "english englisch englische englischen anglais anglaise inglés inglesa ingles",
    "de": "german deutsch deutsche deutschen allemand allemande alemán alemana aleman",
    "fr": "french französisch französische französischen français française francés francesa frances",
    "es": "spanish spanisch spanische spanischen espagnol espagnole español española castellano espanol",
}
_OF_NAME = {name: k for k, v in LANGUAGE_NAMES.items() for name in v.split()}


def language_names(spark: SparkSession) -> dict[str, str]:
    """Code of each language by its names in the four languages, as the JVM knows them. Names of several words and of fewer than four letters are left out."""
    of = spark.sparkContext._jvm.java.util.Locale
    shown = [of.forLanguageTag(k) for k in LANGUAGE_NAMES]
    names = dict(_OF_NAME)
    for code in of.getISOLanguages():
        for name in {of.forLanguageTag(code).getDisplayLanguage(x).lower() for x in shown}:
            if len(name) > 3 and name.isalpha():
                names.setdefault(name, code)
    return names


def is_empty(answer: str | None) -> bool:
    """No answer text, or only a stand-in: tags, punctuation, or a word for nothing."""
    if answer is None:
        return True
    bare = _INVISIBLE.sub("", _TAG.sub("", answer)).lower()
    return bare.strip("\"'“”.,!") in STAND_INS or not any(c.isalnum() for c in bare)


def letters(text: str) -> str:
    return _REST.sub("", text.casefold())


def is_copy(prompt: str, answer: str) -> bool:
    """Whether the answer, but for a label, holds the letters and digits of the whole prompt or of some of its consecutive sentences."""
    for own in {letters(LABEL.sub("", answer, count=1)), letters(answer)}:
        if len(own) < 8:
            continue
        whole = letters(prompt)
        if own == whole:
            return True
        if _CORRECTING.search(prompt):
            continue  # the corrected text may differ in punctuation only
        if len(own) > len(whole) or own not in whole:
            continue
        bounds, n = {0}, 0
        for part in _SENTENCE.split(prompt):
            n += len(letters(part))
            bounds.add(n)
        at = whole.find(own)
        while at >= 0:
            if at in bounds and at + len(own) in bounds:
                return True
            at = whole.find(own, at + 1)
    return False


def subject_words(text: str) -> set[str]:
    """The beginnings of a text's words of four and more letters, without function words."""
    return {w[:5] for w in _LETTERS.findall(text.lower()) if w not in _COMMON}


def asks_to_decline(prompt: str) -> bool:
    """Whether a prompt asks for a text that declines."""
    return bool(_ASKED_TO_DECLINE.search(prompt) and _TASK.search(prompt))


def is_refusal(prompt: str, answer: str) -> bool:
    """Whether the answer declines and gives nothing else. A text that declines because the prompt asks for such a text is none.

    Its sentences (cut at "but" too) decline, deflect (excuse, reason, advice to turn elsewhere) or may answer. One that has a figure, or is long and on the prompt's subject, answers; phone numbers, addresses and dates are no figures unless
    the prompt asks for such. Short ones on its subject and long ones on none are in doubt, and may not have more words than those that decline or deflect."""
    answer = answer.replace("’", "'")
    if not REFUSALS.search(answer) or asks_to_decline(prompt):
        return False
    subject = subject_words(prompt)
    known, asked = set(_NUMBER.findall(prompt)), bool(_ASKED_FOR_ONE.search(prompt))
    own = doubtful = 0
    for sentence in _SENTENCE.split(answer):
        for piece in _BUT.split(sentence):
            n = len(piece.split())
            about = not subject.isdisjoint(subject_words(piece))
            figures = set(_NUMBER.findall(piece if asked else _DATE.sub(" ", _CONTACT.sub(" ", piece))))
            if REFUSALS.search(piece):
                own += n
            elif DEFLECTIONS.search(piece):
                if about and figures - known:
                    return False
                own += n
            elif figures or n > REFUSAL_WORDS and about:
                return False
            elif n > REFUSAL_WORDS or about:
                doubtful += n
    return doubtful <= own


class Rules:
    """What a pair's own text shows. names: of languages; profiles: language model; weights and least: of the refusal model, None for phrases alone."""

    def __init__(self, names: dict[str, str] | None = None, profiles: Profiles | None = None, weights: np.ndarray | None = None, least: float = 2.0) -> None:
        self.names, self.profiles, self.least = names or _OF_NAME, profiles or Profiles([]), least
        self.weights = None if weights is None else [float(w) for w in weights]

    @classmethod
    def fitted(cls, spark: SparkSession, examples: pd.DataFrame) -> Rules:
        """From prompt and completion of pairs that fit into memory: prompts whose function words leave no doubt train the language model, refusals that the phrases find the refusal model."""
        answered = [(p, c) for p, c in zip(examples["prompt"], examples["completion"]) if not is_empty(c)]
        seed = np.array([is_refusal(p, c) for p, c in answered], bool)
        weights, least = refusals.fitted(np.array([refusals.features(p, c) for p, c in answered], float), seed) if len(answered) else (None, 2.0)
        return cls(language_names(spark), Profiles(examples["prompt"]), weights, least)

    def asked_languages(self, prompt: str) -> set[str]:
        return {self.names[w] for w in re.findall(r"[^\W\d_]+", prompt.lower()) if w in self.names}

    def is_foreign(self, prompt: str, answer: str) -> bool:
        """Whether the answer is in a language that is neither the prompt's nor one it asks for; where either can't be told it isn't. Another script is another language; so is a text in none of the known languages to a prompt in one, and the other way round."""
        asked = self.asked_languages(prompt)
        scripts = script(prompt), script(answer)
        if None not in scripts and scripts[0] != scripts[1]:
            return not asked and (scripts[1] != "LATIN" or len(plain_words(answer)) >= 4)
        n = counts(answer)
        own, its = most(n), language(prompt)
        if own is None or its is None or own != its or n[own] < FEW * len(answer.split()):
            seen = self.profiles.of(answer), self.profiles.of(prompt)
            if "other" in seen:
                known = seen[0] if seen[1] == "other" else seen[1]  # the other side's language, which more than one word must show
                return None not in seen and seen[0] != seen[1] and not asked and counts(answer if seen[1] == "other" else prompt)[known] >= 2
        if own is None or its is None or own == its or own in asked:
            return False
        if n[own] >= 2:
            return n[own] >= 3 * n[its]
        backed = support(answer)
        return n[its] == 0 and backed[own] >= max(4, 4 * backed[its])

    def is_refusal(self, prompt: str, answer: str) -> bool:
        """By its phrases, or by how it speaks. What holds a phrase is judged by its content; what declines because the prompt asks for such a text is none."""
        if REFUSALS.search(answer.replace("’", "'")):
            return is_refusal(prompt, answer)
        if self.weights is None or not refusals.likely(refusals.features(prompt, answer), self.weights, self.least):
            return False
        return not asks_to_decline(prompt)

    def of(self, prompt: str, answer: str | None) -> str | None:
        """The defect that a pair's own text shows, but for a cut."""
        if is_empty(answer):
            return "empty"
        if is_copy(prompt, answer):
            return "copy"
        if self.is_refusal(prompt, answer):
            return "refusal"
        return "language" if self.is_foreign(prompt, answer) else None


PARTS = "kind string, example_id long, rule string, lang string, text string, n long, seeds long, top array<double>, block binary"
_COLUMNS = [c.split()[0] for c in PARTS.split(", ")]


def _part(kind: str, rows: int, **columns: object) -> pd.DataFrame:
    return plain(pd.DataFrame({c: [kind] * rows if c == "kind" else columns.get(c, np.full(rows, None, object)) for c in _COLUMNS}))


def _packed(ids: list[int], seed: list[bool], asked: list[bool], x: list[list[float]]) -> pd.DataFrame:
    z = np.array(x, float)
    block = np.array(ids, np.int64).tobytes() + z.tobytes() + np.array(seed, bool).tobytes() + np.array(asked, bool).tobytes()
    return _part("block", 1, n=[len(ids)], seeds=[sum(seed)], top=[np.abs(z).max(axis=0)], block=[block])


def _unpacked(n: int, block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, whether the phrases find a refusal, whether the model is asked, and features of a block of pairs."""
    flags = len(block) - 2 * n
    return np.frombuffer(block, np.int64, n), np.frombuffer(block, bool, n, flags), np.frombuffer(block, bool, n, flags + n), np.frombuffer(block[8 * n : flags]).reshape(n, -1)


def read_once(own: DataFrame) -> DataFrame:
    """PARTS of what the pairs' texts show before anything is fitted: `rule` for each that is empty, a copy or declines by a phrase; `block`: features of answers; `gram` counts and `words` of prompts that are clearly of a language."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: dict = {}
        for b in batches:
            ruled, told, ids, seed, asked, x = [], [], [], [], [], []
            for k, p, c in zip(b["example_id"], b["prompt"], b["completion"]):
                prompt = clear(p) if c is not None else None
                if prompt:
                    told.append(prompt)
                if is_empty(c):
                    ruled.append((k, "empty"))
                    continue
                copy, refused = is_copy(p, c), is_refusal(p, c)
                if copy or refused:
                    ruled.append((k, "copy" if copy else "refusal"))
                ids.append(k)
                seed.append(refused)
                asked.append(not copy and not REFUSALS.search(c.replace("’", "'")) and not asks_to_decline(p))
                x.append(refusals.features(p, c))
            for lang, n in grams_of(told).items():
                grams.setdefault(lang, Counter()).update(n)
            if ruled:
                yield _part("rule", len(ruled), example_id=[k for k, _ in ruled], rule=[r for _, r in ruled])
            if told:
                yield _part("words", len(told), lang=[k for k, _ in told], text=[" ".join(w) for _, w in told])
            if ids:
                yield _packed(ids, seed, asked, x)
            if sum(map(len, grams.values())) > HELD_GRAMS:
                yield from counted(grams)
                grams = {}
        yield from counted(grams)

    def counted(grams: dict) -> Iterator[pd.DataFrame]:
        for lang, n in grams.items():
            yield _part("gram", len(n), lang=[lang] * len(n), text=list(n), n=list(n.values()))

    return own.select("example_id", "prompt", "completion").mapInPandas(read, PARTS)


def profiles_of(parts: DataFrame) -> Profiles:
    """The language model of all prompts. parts: PARTS."""
    grams: dict = {}
    for lang, gram, n in parts.where("kind = 'gram'").groupBy("lang", "text").agg(F.sum("n")).collect():
        grams.setdefault(lang, Counter())[gram] = n
    fit = Profiles(grams=grams)
    shared = parts.sparkSession.sparkContext.broadcast(fit)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums = shared.value.scored((lang, text.split(" ")) for lang, text in zip(b["lang"], b["text"]))
            if sums:
                yield pd.DataFrame([(*key, *value) for key, value in sums.items()], columns=["model", "same", "sum", "n"])

    scored = parts.where("kind = 'words'").select("lang", "text").mapInPandas(score, "model string, same boolean, sum double, n long")
    fit.measure({(r["model"], r["same"]): (r["sum"], r["n"]) for r in scored.groupBy("model", "same").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n")).collect()})
    return fit


def refusal_model(parts: DataFrame) -> tuple[np.ndarray | None, float]:
    """refusals.fitted() of all answers, a pass over their blocks for each step. parts: PARTS."""
    blocks = parts.where("kind = 'block'")
    n, seeds = blocks.agg(F.sum("n"), F.sum("seeds")).first()
    if not n:
        return None, 2.0
    tops = blocks.select(F.posexplode("top")).groupBy("pos").agg(F.max("col").alias("top")).orderBy("pos").collect()
    if not seeds or seeds == n:
        return np.zeros(len(tops)), 2.0
    scale, weight = np.array([r["top"] for r in tops]) + 1e-9, refusals.sides(seeds, n - seeds)

    def moments(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = np.zeros((len(w) + 1, len(w)))
            for b in batches:
                for size, block in zip(b["n"], b["block"]):
                    _, seed, _, x = _unpacked(size, block)
                    gradient, curve = refusals.moments(x / scale, seed, weight, w)
                    sums[0] += gradient
                    sums[1:] += curve
            yield pd.DataFrame({"sums": [sums.tobytes()]})

        total = np.zeros((len(w) + 1, len(w)))
        for r in blocks.select("n", "block").mapInPandas(add, "sums binary").collect():
            total += np.frombuffer(r["sums"]).reshape(total.shape)
        return total[0], total[1:]

    w = refusals.solved(len(scale), moments) / scale

    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for size, block in zip(b["n"], b["block"]):
                _, seed, _, x = _unpacked(size, block)
                p = refusals.probability(x[~seed], w)
                yield pd.DataFrame({"p": p[p > refusals.LEAST - 1e-6]})

    # one row, below at most SLACK of all, comes to the driver
    last = blocks.select("n", "block").mapInPandas(likely, "p double").orderBy(F.desc("p")).offset(refusals.from_top(n - seeds) - 1).limit(1).collect()
    return w, refusals.least_of(last[0]["p"] if last else 0.0)


def modelled(parts: DataFrame, weights: np.ndarray | None, least: float) -> DataFrame:
    """example_id, rule of the pairs that the refusal model finds. parts: PARTS."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for size, block in zip(b["n"], b["block"]):
                ids, _, asked, x = _unpacked(size, block)
                some = np.flatnonzero(asked)
                hit = [k for k in some[refusals.probability(x[some], weights) > refusals.LEAST - 1e-6] if refusals.likely(x[k].tolist(), weights.tolist(), least)]
                yield pd.DataFrame({"example_id": ids[hit], "rule": np.array(["refusal"] * len(hit), object)})

    blocks = parts.where("kind = 'block'" if weights is not None and least <= 1 else "false")
    return blocks.select("n", "block").mapInPandas(find, "example_id long, rule string")


def shortened(answers: DataFrame) -> DataFrame:
    """key (md5) of each text that is a proper prefix of another one. answers: text, not null.

    In sorted order a text that any other starts with stands right before one that does, so only neighbours are compared. Equal texts count as one; of each sorted part only its first and last text meet those of the next part."""
    ranged = answers.select("text").repartitionByRange("text").sortWithinPartitions("text").withColumn("part", F.spark_partition_id())

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, part, first = None, 0, None
        for b in batches:
            hits = []
            for t, part in zip(b["text"], b["part"]):
                if first is None:
                    first = t
                if last is not None and t != last and t.startswith(last):
                    hits.append(last)
                last = t
            yield pd.DataFrame({"part": [int(part)] * len(hits), "kind": np.array(["hit"] * len(hits), object), "text": np.array(hits, object)})
        if first is not None:
            yield plain(pd.DataFrame({"part": [int(part)] * 2, "kind": ["first", "last"], "text": [first, last]}))

    seen = cut(ranged.mapInPandas(neighbours, "part int, kind string, text string"))
    hits = seen.where("kind = 'hit'").select(F.md5("text").alias("key"))
    ends = seen.where("kind <> 'hit'").groupBy("part").pivot("kind", ["first", "last"]).agg(F.first("text"))
    # one row for each part, so the window is small
    over = ends.withColumn("next", F.lead("first").over(Window.orderBy("part"))).where((F.col("next") != F.col("last")) & F.startswith("next", "last")).select(F.md5("last").alias("key"))
    return hits.unionByName(over).distinct()


def shortened_ids(values: DataFrame) -> DataFrame:
    """record_id, short (true) of the values whose text is a proper prefix of another one, both without marks of a cut and spaces at their ends. values: record_id, text; null texts are left out."""

    def bare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"record_id": b["record_id"], "text": np.array([stripped(t)[0].rstrip() for t in b["text"]], object)})

    def different(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:  # a text that a third of all rows have is sent once for each batch
            yield b.drop_duplicates()

    texts = values.where("text is not null and record_id is not null").select("record_id", "text").mapInPandas(bare, "record_id long, text string")
    short = cut(shortened(texts.select("text").mapInPandas(different, "text string")))
    keyed = texts.withColumn("key", F.md5("text")).select("record_id", "key")
    return keyed.join(F.broadcast(short) if short.count() <= SMALL_KEYS else short, "key", "left_semi").select("record_id", F.lit(True).alias("short")).distinct()


def defects(examples: DataFrame) -> DataFrame:
    """example_id, defect: empty, truncated, refusal, copy or language.

    examples: example_id (unique), prompt, completion, source. Pairs with a null or blank prompt are no case, a null completion is empty, rows without an
    id are left out, a row that is there twice counts once, an empty table gives no rows. Texts are read whole. The models of languages and refusals are fitted on all pairs with a completion. Where several rules hold the order is empty, copy, refusal, truncated, language.
    """
    own = examples.select("example_id", "prompt", "completion", "source").where(F.col("example_id").isNotNull() & F.col("prompt").rlike(r"[^\s\x{200b}\x{feff}]"))

    parts = stored(read_once(own), "pairs")
    weights, least = refusal_model(parts)
    shared = own.sparkSession.sparkContext.broadcast(Rules(language_names(own.sparkSession), profiles_of(parts), weights, least))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = shared.value
        for b in batches:
            keep = np.array([not is_empty(c) and judge.is_foreign(p, c) for p, c in zip(b["prompt"], b["completion"])], bool)
            yield pd.DataFrame({"example_id": b["example_id"].to_numpy()[keep], "rule": np.array(["language"] * keep.sum(), object)})

    found = parts.where("kind = 'rule'").select("example_id", "rule").unionByName(modelled(parts, weights, least))
    found = found.unionByName(own.select("example_id", "prompt", "completion").mapInPandas(read, "example_id long, rule string"))
    # of several rules the first: empty, copy, refusal, language
    ruled = found.groupBy("example_id").agg(F.min_by("rule", F.array_position(F.array(*map(F.lit, ORDER)), F.col("rule"))).alias("rule"))
    values = examples.select(F.col("example_id").alias("record_id"), F.lit("completion").alias("field_name"), "source", F.col("completion").alias("text"))
    doubtful = judged(values).where(F.col("log_odds") < SHORTENED)
    short = shortened_ids(values)
    cut_rows = doubtful.join(short, "record_id", "left").where(F.col("cut") | F.col("short") & (F.col("log_odds") + F.col("prior") < SHORTENED) & (F.col("log_odds") < 0)).select(F.col("record_id").alias("example_id"), F.lit("truncated").alias("t"))
    both = own.select("example_id").join(ruled.join(cut_rows, "example_id", "full"), "example_id")
    defect = F.when(F.col("t").isNull() | F.col("rule").isin("empty", "copy", "refusal"), F.col("rule")).otherwise(F.col("t"))
    return both.select("example_id", defect.alias("defect")).distinct()
