"""Problem 1: defective answers of preference pairs.

Each answer is unwrapped (code fences, single quotes, stray commas, unclosed objects) to its
rationale. Word-shingle containment in the prompt's extract and the longest common subsequence
with it, sentence by sentence, tell copies (sentences may be reordered); the longest common subsequence with refusal templates tells refusals;
function words tell the language. One defect per answer, the first that holds of: empty,
refusal, copy, language, truncated. A map over rows: nothing is shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame

from .textform import WORD, consistent

# How refusals begin. "…" stands for any words.
REFUSALS = [
    "je suis désolé mais je ne peux pas",
    "désolé je ne peux pas",
    "désolé il m est impossible",
    "il m est impossible de",
    "navré je dois décliner",
    "je dois décliner",
    "je regrette mais je ne peux pas",
    "je m abstiens",
    "je préfère ne pas",
    "je refuse de",
    "je ne suis pas en mesure de",
    "je ne suis pas autorisé à",
    "je ne peux pas répondre",
    "je ne peux pas traiter",
    "je ne peux pas fournir",
    "en tant que modèle de langage",
    "en tant qu assistant",
    "en tant qu intelligence artificielle",
    "cette demande dépasse",
    "i am sorry but i cannot",
    "i m sorry but i can t",
    "sorry i cannot",
    "sorry i can t",
    "i cannot assist",
    "i cannot help",
    "i cannot provide",
    "i am unable to",
    "i m unable to",
    "i am not able to",
    "i must decline",
    "i prefer not to",
    "i would rather not",
    "as a language model",
    "as an ai",
    "this request exceeds",
    "this request goes beyond",
]
# Frequent function words that tell one language from the others.
FUNCTION_WORDS = {
    "fr": "le la les l un une de des du d à au aux et est que qui dans par pour sur avec ce cette ces ne pas se il elle on y en sans sont ou où son sa ses leur mais donc comme",
    "en": "the a an of and to in is that for on with as by this it are be from at or its which not no was has have but therefore",
    "de": "der die das ein eine einen einem einer und ist nicht den dem des mit für auf von zu im es sich wird daher als auch nennt aus nach bei oder",
    "es": "el los las un una y es que en por para con del al se no lo su este esta ello como sin más pero son trata",
    "it": "il lo gli i un uno una e è che di del della dei delle in per con non si questo questa al alla da sono ma come",
    "pt": "o os as um uma e é que em por para com do da dos das não se no na ao este esta mas como são",
    "nl": "de het een en is van dat in op te voor met niet zijn aan deze dit door om ook wordt als",
}
_OF_WORD: dict[str, list[str]] = {}
for _lang, _list in FUNCTION_WORDS.items():
    for _w in _list.split():
        _OF_WORD.setdefault(_w, []).append(_lang)
_LETTERS = {"fr": "èêçœàùûîôë", "de": "äöüß", "es": "ñ¿¡óíú", "it": "ìò", "pt": "ãõ"}

SHINGLE, CONTAINED, ALIGNED = 3, 0.8, 0.9
RATIONALE_KEYS = ("chain_of_thought", "rationale", "reasoning")
_FENCE = re.compile(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$")
_EXTRACT = re.compile(r"«(.*)»", re.S)
_KEY = re.compile(r"""["'](?:%s)["']\s*:\s*""" % "|".join(RATIONALE_KEYS))


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    v = full = (1 << len(a)) - 1
    for w in b:
        u = v & at.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def language(text: str) -> str | None:
    """The language with the clearly highest score of function words and letters, else None."""
    score = dict.fromkeys(FUNCTION_WORDS, 0.0)
    low = text.lower()
    for w in WORD.findall(low):
        for lang in _OF_WORD.get(w, ()):
            score[lang] += 1 / len(_OF_WORD[w])
    for lang, letters in _LETTERS.items():
        score[lang] += 0.5 * sum(low.count(c) for c in letters)
    (first, best), (_, second) = sorted(score.items(), key=lambda x: -x[1])[:2]
    return first if best >= 1 and best >= 1.25 * second else None


def unwrap(answer: str) -> tuple[str | None, bool]:
    """The rationale of an answer (None if it has none) and whether the answer is closed."""
    body = _FENCE.sub("", _FENCE.sub("", answer)).strip()
    if not body or not body.strip("\"' \n\t"):
        return None, True
    if body[0] not in "{[":
        return body.strip("\"'").strip() or None, True
    closed = body.rstrip().endswith(("}", "]"))
    for attempt in (body, re.sub(r",(\s*[}\]])", r"\1", body)):
        try:
            value = json.loads(attempt)
        except ValueError:
            continue
        if isinstance(value, dict):
            low = {str(k).strip().lower(): v for k, v in value.items()}
            got = next((low[k] for k in RATIONALE_KEYS if low.get(k) is not None), None)
            return (str(got).strip() or None if got is not None else None), True
        return None, True
    m = _KEY.search(body)
    if not m:
        return None, closed
    rest = body[m.end() :].strip()
    if rest[:1] not in "\"'":
        return None, closed or not rest
    quote, rest = rest[0], rest[1:]
    end = re.search(rf"{quote}\s*,?\s*(?:\}}|{quote}\w+{quote}\s*:)", rest)
    text = rest[: end.start()] if end else rest
    return text.replace(f"\\{quote}", quote).strip() or None, bool(end) and closed


def _refuses(words: list[str]) -> bool:
    """Some template is a subsequence of the beginning, from one of the first three words on."""
    for first in set(words[:3]):
        for t in _BY_FIRST.get(first, ()):
            head = words[: len(t) + 4]
            if len(head) >= len(t) and common_length(t, head) == len(t):
                return True
    return False


_BY_FIRST: dict[str, list[list[str]]] = {}
for _t in map(str.split, REFUSALS):
    _BY_FIRST.setdefault(_t[0], []).append(_t)


class Prompt:
    """What the answers to one prompt are compared with; each part is made when first asked for."""

    def __init__(self, prompt: str | None):
        self.text = consistent(prompt or "")

    @cached_property
    def words(self) -> list[str]:
        return WORD.findall(self.text.lower())

    @cached_property
    def shingles(self) -> set[tuple[str, ...]]:
        return set(_runs(self.words))

    @cached_property
    def language(self) -> str | None:
        m = _EXTRACT.search(self.text)
        return language(m.group(1) if m else self.text)

    def holds(self, rationale: str, words: list[str]) -> bool:
        """The rationale is taken from the prompt: its runs of words are there, and so are the words
        of its sentences in their order."""
        own = _runs(words)
        if len(words) < 2 * SHINGLE or sum(s in self.shingles for s in own) < CONTAINED * len(own):
            return False
        aligned = sum(common_length(WORD.findall(x), self.words) for x in re.split(r"(?<=[.!?])\s+", rationale.lower()))
        return aligned >= ALIGNED * len(words)


def _runs(words: list[str]) -> list[tuple[str, ...]]:
    return list(zip(*[words[k:] for k in range(SHINGLE)]))


def defect(prompt: str | None | Prompt, answer: str | None) -> str | None:
    """The defect of one answer, or None. A null prompt has an empty extract."""
    if answer is None or not answer.strip():
        return "empty"
    rationale, closed = unwrap(consistent(answer))
    if rationale is None:
        return "empty" if closed else "truncated"
    words = WORD.findall(rationale.lower())
    if not words:
        return "empty" if closed else "truncated"
    if _refuses(words):
        return "refusal"
    if not isinstance(prompt, Prompt):
        prompt = Prompt(prompt)
    if prompt.holds(rationale, words):
        return "copy"
    own = language(rationale)
    if own and prompt.language and own != prompt.language:
        return "language"
    if not closed or rationale.endswith(("...", "…")) or not re.search(r"[.!?][\"'»”)\]]*$|[.!?]\s*[»”]$", rationale):
        return "truncated"
    return None


def defective_answers(df: DataFrame, key: str = "pair_id", prompt: str = "prompt", fields: tuple[str, ...] = ("chosen", "rejected")) -> DataFrame:
    """``(key, field, defect)`` of each defective answer; other columns are ignored.

    A null or blank answer is empty; an answer to a null prompt can be neither copy nor of
    another language. Rows with a null key come out under null. An empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, p, *answers in zip(*[b[c].tolist() for c in (key, prompt, *fields)]):
                p = Prompt(p)
                out += [(k, f, d) for f, a in zip(fields, answers) if (d := defect(p, a))]
            if out:
                yield pd.DataFrame(out, columns=[key, "field", "defect"])

    return df.select(key, prompt, *fields).mapInPandas(run, f"{key} string, field string, defect string").distinct()
