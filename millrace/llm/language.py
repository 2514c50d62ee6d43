"""Languages of texts: by their script, by the function words of four languages, and by a character n-gram model that is trained
on texts whose function words leave no doubt, which also tells what is in none of these languages."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

# Frequent function words of four languages. Those that several of them share support each of these, but decide for none.
FUNCTION_WORDS = {
    "en": "a in on no me the of and to is was are were with that this which from at by for not it as if when what how why before after than over only would should could can will has have had been there their its an under until while although because so or but about into between within without during please since every more then nothing again first both each such than even",
    "de": "in der die das und ist war sind nicht mit von dem den ein eine einer eines zu auf bei bis für wird werden wurde dass sich auch nach aus wenn wie was warum vor über unter nur hat haben durch ohne zwischen weil obwohl während seit ab um im am zum zur noch dann lag sollte bitte wir sodass bevor hinter kann ich dir ihnen diese",
    "fr": "on me la de et en à le les des du une est était sont pas avec pour dans sur par qui que ce cette ces aux il elle nous vous au mais ou où donc sans entre plus moins avant après pendant quand comment pourquoi faut ont été parce bien alors sous vers depuis puis seuls je ne peux votre à l d qu",
    "es": "la de a y el los las una es era fue son con para por que no del al se su sus lo pero o donde sin entre más menos antes después durante cuando cómo qué cuánto hay estaba porque aunque mientras bajo desde hasta luego así solo y en como esta este le puedo mi",
}
# Letters and signs that point to a language.
SIGNS = {"es": "¿¡ñ", "de": "ßäöü", "fr": "çœêèàâîûë"}
WORD = re.compile(r"(?<![^\W_])[^\W\d_]+(?![^\W_])")
_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_SHARED = {w for k, v in _SETS.items() for w in v if sum(w in o for o in _SETS.values()) > 1}
SETS = {k: v - _SHARED for k, v in _SETS.items()}
_OF_WORD: dict[str, str] = {w: k for k, v in SETS.items() for w in v}


# Letters of scripts that put no spaces between words: each counts as a word.
_UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\U00020000-\U0003FFFF"
_WORDS = re.compile(rf"[{_UNSPACED}]|[^\s{_UNSPACED}]+")


def words_in(text: str) -> int:
    """How many words a text has, by its spaces; in scripts that have none, how many letters."""
    return len(_WORDS.findall(text))


def support(text: str) -> dict[str, int]:
    """Function words of each language in a text, shared ones for each language that has them."""
    out = dict.fromkeys(SETS, 0)
    for w in WORD.findall(text.lower()):
        for k, words in _SETS.items():
            out[k] += w in words
    return out


def counts(text: str) -> dict[str, int]:
    """Function words of each language in a text; one more for its signs."""
    low = text.lower()
    out = {k: int(any(c in low for c in SIGNS.get(k, ""))) for k in SETS}
    for w in WORD.findall(low):
        k = _OF_WORD.get(w)
        if k:
            out[k] += 1
    return out


def language(text: str) -> str | None:
    """The language with most function words, if it has twice as many as any other; None where that can't be told."""
    return most(counts(text))


def most(n: dict[str, int]) -> str | None:
    ranked = sorted(n.items(), key=lambda x: -x[1])
    return ranked[0][0] if ranked[0][1] >= 1 and ranked[0][1] >= 2 * ranked[1][1] else None


@lru_cache(maxsize=100_000)
def _script_of(c: str) -> str:
    name = unicodedata.name(c, "?").split()[0].split("-")[0]
    return "KANA" if name in ("HIRAGANA", "KATAKANA", "HALFWIDTH") else "LATIN" if name == "FULLWIDTH" else name


def script(text: str, share: float = 0.6) -> str | None:
    """The script of at least this share of a text's letters; Chinese characters beside kana are Japanese. None without letters, or where no script has as many."""
    if text.isascii():
        return "LATIN" if any(map(str.isalpha, text)) else None
    n: Counter = Counter()
    for c, k in Counter(text).items():
        if c.isalpha():
            n[_script_of(c)] += k
    if n["KANA"] * 10 > n["CJK"]:
        n["KANA"] += n.pop("CJK", 0)
    total = sum(n.values())
    best = max(n, key=n.__getitem__, default=None)
    return best if total and n[best] >= share * total else None


# Lengths of the model's n-grams and of the words that it reads.
GRAM, LEAST_WORDS = 3, 6
_PLAIN = re.compile(r"(?<![^\s\"'“”«»(¿¡])[^\W\d_]+(?:['’][^\W\d_]+)?(?=[\s.,;:!?\"'“”»)…]|$)")


def plain_words(text: str) -> list[str]:
    """Words of letters only, in lower case; what is part of a name of a file or of code is none, nor are names and abbreviations within a sentence."""
    out, before = [], ""
    for m in _PLAIN.finditer(text):
        w, before = m.group(), text[: m.start()].rstrip()[-1:]
        if w[1:].islower() and (w[0].islower() or before in ("", ".", "!", "?", ":", "\n")) or len(w) == 1:
            out.append(w.lower())
    return out


def _grams(words: Iterable[str]) -> Iterable[str]:
    for w in words:
        w = f" {w} "
        for k in range(len(w) - GRAM + 1):
            yield w[k : k + GRAM]


def clear(text: str) -> tuple[str, list[str]] | None:
    """Language and plain words of a text whose function words leave no doubt."""
    n = counts(text)
    own = most(n)
    return (own, plain_words(text)) if own and n[own] >= 3 and n[own] >= 4 * (sum(n.values()) - n[own]) else None


def grams_of(told: Iterable[tuple[str, list[str]]]) -> dict[str, Counter]:
    """The n-grams of clear() texts, counted by language."""
    out: dict[str, Counter] = {}
    for own, words in told:
        out.setdefault(own, Counter()).update(_grams(words))
    return out


class Profiles:
    """Character n-gram model of the languages of some texts. `of` gives a text's language among them, "other" for a text of words in none of them, None where nothing can be told."""

    def __init__(self, texts: Iterable[str] = (), grams: dict[str, Counter] | None = None) -> None:
        """From texts; or from the grams_of() all of them, for scored() and measure() to follow."""
        told = [t for t in map(clear, texts) if t]
        self.counted = grams_of(told) if grams is None else grams
        self.scores: dict[str, dict[str, float]] = {}
        self.totals: dict[str, float] = {}
        #: For each language what its own texts score on average, and what those of the others score there.
        self.usual: dict[str, tuple[float, float]] = {}
        for own, n in self.counted.items():
            self.totals[own] = total = sum(n.values()) + 0.5 * (len(n) + 1000)
            self.scores[own] = {g: math.log((c + 0.5) / total) for g, c in n.items()}
        if grams is None:
            self.measure(self.scored(told))

    def scored(self, told: Iterable[tuple[str, list[str]]]) -> dict[tuple[str, bool], tuple[float, int]]:
        """By model, and whether the texts are of its language: sum of what clear() texts score, and their number. A text of its language is scored without its own part in the model."""
        out: dict[tuple[str, bool], tuple[float, int]] = {}
        for own, words in told:
            if len(words) >= LEAST_WORDS:
                for k in self.scores:
                    x, n = out.get((k, k == own), (0.0, 0))
                    out[k, k == own] = x + (self._without(words, k) if k == own else self._mean(words, k)), n + 1
        return out

    def measure(self, sums: dict[tuple[str, bool], tuple[float, int]]) -> None:
        for k in self.scores:
            (x, n), (y, m) = (sums.get((k, same), (0.0, 0)) for same in (True, False))
            if n >= 5 and m >= 5:
                self.usual[k] = (x / n, y / m)
        self.counted = {}

    def _without(self, words: list[str], own: str) -> float:
        n, grams = self.counted[own], Counter(_grams(words))
        size = sum(grams.values())
        return sum(c * math.log((n[g] - c + 0.5) / (self.totals[own] - size)) for g, c in grams.items()) / max(size, 1)

    def _mean(self, words: list[str], own: str) -> float:
        known, unseen = self.scores[own], math.log(0.5 / self.totals[own])
        x = [known.get(g, unseen) for g in _grams(words)]
        return sum(x) / max(len(x), 1)

    def distance(self, words: list[str], own: str) -> float:
        """How far words are from a language: about 0 for its own texts, 1 for those of other languages."""
        usual, other = self.usual[own]
        return (usual - self._mean(words, own)) / max(usual - other, 1e-9)

    def of(self, text: str) -> str | None:
        """Texts of fewer than LEAST_WORDS plain words are told by function words alone, as language() tells them. A longer one is "other" if hardly any of its words are function words of its nearest language, and it is as far from that as texts of other languages are."""
        told, words = language(text), plain_words(text)
        if len(words) < LEAST_WORDS or not self.usual:
            return told
        far, near = min((self.distance(words, k), k) for k in self.usual)
        return "other" if far > FAR and sum(w in _SETS[near] for w in words) < FEW * len(words) else told


# Below which share of function words, and how far from its nearest language, a text is in another.
FEW, FAR = 0.2, 0.6
