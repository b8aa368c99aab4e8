"""Language of a short text by its function words (English, French, German, Spanish; Italian, Portuguese and Dutch to tell them apart)."""

from __future__ import annotations

import re

import numpy as np

from lodestack.llm import words as W

# Function words and names of the languages.
FUNCTION_WORDS = {
    "en": "the of and to in is are was were be been that which what who whom whose how when where why this these those with from for on at by as it its he she they we you i my your our their not no yes or if can could will would should do does did has have had than then there any some only please into about after before until because so see list give explain compare draft between within each nobody unless without lot asks days page pls check whether still turn annex",
    "fr": "le la les un une des du de et à au aux est sont était que qui quoi quel quels quelle quelles dans pour par sur avec sans ce cette ces il elle ils elles nous vous je ne pas plus ou où si mon ma mes votre notre leur son sa ses en y dit entre depuis avant après selon tant faute oui non seulement jours afin chez explique résume valide lié liés impose liée",
    "de": "der die das den dem des ein eine einen einem einer und oder ist sind war waren wird werden hat haben nicht kein keine in im am an auf für mit von vom zu zum zur bei nach über unter was wer wie wann wo warum ich wir sie er es uns mir dass noch nur ja nein aus als durch ohne laut genau seit gilt heute tage tagen zwischen los kostet rund steht muss darf leider dabei",
    "es": "el la los las un una unos unas de del y o en es son era que qué quién cuál cuáles cómo cuándo dónde por para con sin sobre este esta estos estas no sí se su sus lo al como más pero según desde entre hasta antes después tras está me mi nos hay sigue vigente cuesta días solo firma dice puedo siento resume lote exige abarca",
}
# Function words of languages that are told apart from these.
OTHER_WORDS = {
    "it": "il lo gli uno di del della dei delle degli dal dalla nel nella sul sulla che chi cui non è sono con tra fra come quando dove perché anche più questo questa questi lui lei noi voi loro ci ho ha hanno essere ma alla dopo prima deve quale",
    "pt": "o os um uma uns umas do da dos das em na nos nas quem não é são com como quando onde porque mais ele ela nós eles seu sua ao aos ou mas pelo pela depois antes já muito qual deve",
    "nl": "het een van en op te dat voor met zijn niet aan er om ook als maar bij door nog naar uit wordt worden kan geen ik je hij zij wij dit deze hoe wat wie waar waarom moet welke",
}
LANGUAGE_NAMES = {
    "en": "english anglais englisch englische englischer inglés ingles",
    "fr": "french français francais französisch französische francés frances",
    "it": "italian italien italienisch italiano", "pt": "portuguese portugais portugiesisch portugués português", "nl": "dutch néerlandais niederländisch neerlandés nederlands",
    "de": "german allemand deutsch deutsche alemán aleman",
    "es": "spanish espagnol spanisch spanische español espanol castellano",
}

_SPEAKS: dict[str, list[int]] = {}
LANGUAGES = FUNCTION_WORDS | OTHER_WORDS
for _place, _words in enumerate(LANGUAGES.values()):
    for _word in set(_words.split()):
        _SPEAKS.setdefault(_word, []).append(_place)
_NAMES = {name: lang for lang, names in LANGUAGE_NAMES.items() for name in names.split()}
_REQUEST = re.compile(r"\b(?:in|into|to|en|auf|ins|al|a|to be)\s+(?:\w+\s+)?(" + "|".join(sorted(_NAMES)) + r")\b")
# Letters that speak for a language.
LETTERS = {"fr": "àâçèêëîïôûùœ", "de": "äöüß", "es": "ñ¿¡óáíú"}
_tables: dict[str, np.ndarray] = {}


def _lookup() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the function words and, for each, a row of ones and zeros by language."""
    if "hash" not in _tables:
        words = sorted(_SPEAKS)
        hashes = W.scan(words)[0]
        order = np.argsort(hashes)
        rows = np.zeros((len(words), len(LANGUAGES)))
        for i, w in enumerate(words):
            rows[i, _SPEAKS[w]] = 1
        _tables["hash"], _tables["rows"] = hashes[order], rows[order]
    return _tables["hash"], _tables["rows"]


def detect(text: str) -> str | None:
    """The language of one text; see :func:`detect_all`."""
    return detect_all([text])[0]


def detect_all(texts: list[str]) -> list[str | None]:
    """For each text the language with the most function words; None where no word speaks for one or two are level."""
    out: list[str | None] = []
    for first, last in W.slices(texts):
        out.extend(_detect([t.lower() for t in texts[first:last]]))
    return out


def _detect(lowered: list[str]) -> list[str | None]:
    known, rows = _lookup()
    hashes, owner, _ = W.scan(lowered)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    hit = known[at] == hashes
    score = np.stack([np.bincount(owner[hit], weights=rows[at[hit], k], minlength=len(lowered)) for k in range(rows.shape[1])], 1)
    cps = W.code_points("\0".join(lowered))
    high = np.flatnonzero(cps >= 128)
    if len(high):
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in lowered]), high, side="right")
        for lang, letters in LETTERS.items():
            has = np.isin(cps[high], W.code_points(letters))
            score[:, list(LANGUAGES).index(lang)] += 0.5 * np.minimum(2, np.bincount(text[has], minlength=len(lowered)))
    ranked = np.sort(score, axis=1)
    names = list(LANGUAGES)
    return [names[k] if clear else None for k, clear in zip(score.argmax(1).tolist(), (ranked[:, -1] > ranked[:, -2]).tolist(), strict=True)]


def requested(text: str) -> set[str]:
    """Languages that a message asks to be answered in."""
    return {_NAMES[m] for m in _REQUEST.findall(text.lower())}
