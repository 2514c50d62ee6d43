"""Refusals by a fitted model: how an answer speaks, not which phrase it uses.

Answers that the phrases of pairs.py find are the seeds. From them and from other answers a logistic model learns what refusals are like in
words that say nothing of a subject (first person, denial, wish, pointing at the request), in figures, and in what they share with the prompt.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Callable

import numpy as np

# Words of four languages that point to the speaker, deny, wish or may, point at what was asked, name the request, and are polite.
CLASSES = {
    "speaker": "i me my mine myself we us our i'm i'd i'll i've ich mir mich mein meine meiner wir uns je j moi mon ma mes m nous yo mí mi mis nos me",
    "denial": "not no never nothing neither nor beyond outside can't cannot won't isn't don't wouldn't couldn't shouldn't nicht kein keine keinen keiner nichts nie außerhalb ne pas non jamais rien aucun aucune hors n ni nunca nada ningún ninguna fuera",
    "wish": "can could will would may must should able want wish prefer like going need let let's rather have i'd i'll kann könnte darf dürfen möchte werde will muss lieber peux puis veux vais dois souhaite préfère puedo puede quiero voy debo prefiero",
    "pointing": "this that these those such it one so das dies diese dieser diesem dieses dazu davon darüber damit hierzu hierbei dessen cela ça ceci ce cet cette là dessus y en lo esto eso esta este ese esa ello",
    "request": "question request topic subject answer help asked ask asking prompt matter scope comment anfrage frage thema antwort auskunft hilfe demande sujet réponse répondre aide pregunta petición solicitud tema asunto respuesta responder contestar ayuda alcance",
    "polite": "sorry afraid apologies unfortunately please thanks thank regret leider bitte danke entschuldigung désolé désolée malheureusement merci lamento siento gracias temo",
}
_SETS = [frozenset(w.split()) for w in CLASSES.values()]
_CLASS_OF = {w: tuple(k for k, s in enumerate(_SETS) if w in s) for w in frozenset().union(*_SETS)}
_DIGIT = re.compile(r"\d")
_WORD = re.compile(r"[^\W\d_]+(?:'(?:t|s|m|d|ll|ve|re)\b)?")
#: Strength of the ridge of the fit.
RIDGE = 1e-3
#: Of the answers without a seed, this share at most may look like a refusal; and so likely must one be.
SLACK, LEAST = 0.0005, 0.9


def features(prompt: str, answer: str) -> list[float]:
    words = _WORD.findall(answer.lower().replace("’", "'"))
    n = max(len(words), 1)
    counts, content = [0] * len(_SETS), []
    for w in words:
        of = _CLASS_OF.get(w)
        if of is not None:
            for k in of:
                counts[k] += 1
        elif len(w) > 3:
            content.append(w[:5])
    asked = {w[:5] for w in _WORD.findall(prompt.lower()) if len(w) > 3 and w not in _CLASS_OF} if content else ()
    about = sum(w in asked for w in content)
    has = [min(c, 2) / 2 for c in counts]
    speaker, denial, wish, pointing, request, polite = (c > 0 for c in counts)
    return [
        *(c / n for c in counts), *has, float(speaker and denial), float(speaker and pointing), float(denial and pointing), float((speaker or request) and denial and pointing), float(request and denial), float(wish and denial and speaker),
        about / n, float(about > 0), len(content) / n, math.log1p(n), float(bool(_DIGIT.search(answer))), float(n < 3), float("\n" in answer.strip()), 1.0,
    ]


def fitted(x: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, least probability) of a logistic model for answers with a seed against the others, both sides with the same weight in all. Without seeds, or with nothing else, nothing is a refusal."""
    if not seed.any() or seed.all():
        return np.zeros(x.shape[1]), 2.0
    scale, weight = np.abs(x).max(axis=0) + 1e-9, sides(int(seed.sum()), int((~seed).sum()))
    w = solved(x.shape[1], lambda w: moments(x / scale, seed, weight, w)) / scale
    others = np.sort(probability(x[~seed], w))
    return w, least_of(others[len(others) - from_top(len(others))])


def sides(seeds: int, others: int) -> tuple[float, float]:
    """What an answer without and one with a seed weighs."""
    return 0.5 / others, 0.5 / seeds


def moments(z: np.ndarray, seed: np.ndarray, weight: tuple[float, float], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the loss of some answers; those of several parts add up. z: scaled features."""
    p, u = probability(z, w), np.where(seed, weight[1], weight[0])
    return z.T @ (u * (p - seed)), (z * (u * p * (1 - p))[:, None]).T @ z


def solved(size: int, of: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weights by Newton steps with a ridge. of: moments of all answers under some weights."""
    w = np.zeros(size)
    for _ in range(25):
        gradient, curve = of(w)
        step = np.linalg.solve(curve + RIDGE * np.eye(size), gradient + RIDGE * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def from_top(others: int) -> int:
    """The rank, from the largest probability of the answers without a seed, of the last that is not taken for a refusal by SLACK."""
    return others - min(others - 1, int(others * (1 - SLACK)))


def least_of(probability: float) -> float:
    return float(max(LEAST, probability + 1e-9))


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def likely(x: list[float], w: list[float], least: float) -> bool:
    """Whether one answer's probability reaches the least."""
    return least <= 1 and sum(map(operator.mul, x, w)) >= math.log(least / (1 - least))
