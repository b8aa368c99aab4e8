"""Broken prompt and response pairs: empty, truncated, refusing, copying and wrong-language answers.

Answers are sorted by text and held against their neighbours: an answer that is a proper beginning
of the next one is a shortened version.  Answer lengths with far more rows than their neighbouring
lengths are limits; an unfinished ending at a limit is a cut.  Other endings are judged by
:mod:`lodestack.llm.endings`; copies, refusals, language and emptiness by rules on the whole answer.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lodestack.llm import endings, language
from lodestack.llm.truncation import significant_lengths
from lodestack.session import keep

THINK = re.compile(r"<(think|thinking|thought|reasoning)>.*?(?:</\1>|\Z)", re.S | re.I)
TAG = re.compile(r"</?[a-zA-Z][^<>]*>|&nbsp;")
# Control and format characters, and blanks of other widths.
INVISIBLE = re.compile("[\\x00-\\x08\\x0b-\\x1f\\x7f-\\xa0\\xad\\u034f\\u061c\\u115f\\u1160\\u17b4\\u17b5\\u180b-\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u206f\\u3000\\u3164\\ufe00-\\ufe0f\\ufeff\\uffa0\\ufff9-\\ufffb]")
WORD = re.compile(r"[^\W_]+")
# Placeholders that stand for no answer, compared without case, spaces and punctuation.
PLACEHOLDERS = frozenset("na,null,nil,nan,empty,noneprovided,notprovided,noanswer,noresponse,noanswerprovided,tbd,todo,tba,placeholder,undefined,blank,noresponseprovided,nocontent,keineantwort,keineangabe,ka,sansréponse,nonrenseigné,vide,sinrespuesta,vacío,leer,pasderéponse".split(","))
# Openings of refusals; each must begin a sentence.
REFUSAL = re.compile(
    r"""(?:^|(?<=[.!?:,;\n]\s)|(?<=\n)|(?<=^["“«]))\W*(?:(?:sorry|apologies|regrettably|unfortunately|i'm\s+sorry|i\ am\ sorry|i\ apologi[sz]e|as\ an?\ (?:ai\ |language\ )*(?:assistant|model)|désolée?|malheureusement|leider|lo\ siento|lamentablemente|je\ suis\ désolée?|es\ tut\ mir\ leid|tut\ mir\ leid|entschuldigung|nothing\ in\ this\ \w+\ lets\ me\ answer)[,.!:;]?\s*(?:but\s+|mais\s+|aber\s+|pero\s+)?)*
    (?:(?:i|we)(?:\ (?:can\s*not|can't|could\ not|couldn't|won't|will\ not|am\ not|'m\ not|are\ not|must|have\ to|need\ to|would|would\ rather|prefer|decline|refuse|do\ not|don't)|'m\ (?:un|not\ )able|\ am\ unable|\ are\ unable|'d\ rather)\b(?!\ overstate).{0,40}?\b(?:help|assist|answer|comply|share|discuss|comment|decline|refuse|provide|respond|able|say|talk|speak|reveal|fulfil\w*|process|not)\b
    |(?:i|we)(?:\ (?:can\s*not|can't|could\ not|couldn't|may\ not|won't|will\ not)|(?:'m|\ am|'re|\ are)\ (?:unable\ to|not\ (?:able|allowed|permitted|authori[sz]ed)\ to))\b(?!\ (?:overstate|overemphasi[sz]e|stress|emphasi[sz]e|wait)\b)
    |(?:that|this)(?:,|\ is\ something|'s\ something)?\ (?:i|we)\ (?:can\s*not|can't|may\ not|won't|am\ not\ (?:able|allowed|permitted)|'m\ not\ (?:able|allowed|permitted))\b
    |(?:das|dies|so\ etwas|darauf|dazu|darüber|hierzu|hierauf|hierüber|dabei)\ (?:kann|darf|können|dürfen)\ (?:ich|wir)\b[^.!?]{0,60}\b(?:nicht|nichts|kein\w*)\b|(?:ich|wir)\ (?:können|dürfen)\b[^.!?]{0,60}\b(?:nicht|keine?n?)\b|(?:ich\ bin|wir\ sind)\ (?:dazu\ )?nicht\ (?:in\ der\ lage|befugt|berechtigt)
    |(?:(?:cela|ça),?\ )?(?:je\ ne\ (?:peux|puis|saurais)\b|nous\ ne\ (?:pouvons|saurions)\ pas|(?:je\ ne\ suis|nous\ ne\ sommes)\ pas\ (?:en\ mesure|autorisé|habilité)|nous\ n['’]avons\ pas\ le\ droit)(?!\ (?:pas\ )?(?:assez|trop)\b)
    |(?:eso\ |esto\ )?no\ (?:(?:lo\ )?(?:puedo|podemos)|(?:me|nos)\ es\ posible|estamos\ autorizad|se\ me\ permite)\b(?!\ (?:exagerar|subrayar|dejar\ de|esperar)\b)
    |(?:that|this)\ (?:isn't|is\ not)\ something\ (?:i|we)\b|(?:i|we)(?:'ll|\ will|\ have\ to|\ must|'d\ rather|\ would\ rather)\ pass\ on\b|(?:i|we)(?:'m|\ am|'re|\ are)\ not\ comfortable\b
    |(?:mi\ dispiace,?\ (?:ma\ )?)?non\ (?:posso|possiamo|mi\ è\ permesso|sono\ (?:autorizzat|in\ grado))|preferisco\ non\b
    |no\ answer\ can\ be\ given|(?:that's|this\ is|that\ is)\ (?:something\ i\ would\ rather\ not|outside\ my|beyond\ (?:my|what\ i))|my\ (?:guidelines|rules|policies|instructions)\ (?:prevent|forbid|do\ not\ allow|don't\ allow)
    |this\ (?:request|question)\ (?:goes\ beyond|exceeds|is\ beyond)\ (?:what\ i|my)|nothing\ in\ this\ \w+\ lets\ me\ answer
    |je\ (?:ne\ peux\ pas|ne\ suis\ pas\ (?:en\ mesure|autorisée?)|ne\ saurais|préfère\ ne\ pas|refuse|dois\ (?:refuser|décliner))|il\ m['’]est\ (?:impossible|interdit)\ de|cette\ (?:question|demande)\ dépasse\ ce\ que\ je|je\ n['’]ai\ pas\ le\ droit
    |(?:diese|die|ihre)\ (?:anfrage|frage|bitte)\ (?:muss\ ich|kann\ ich|darf\ ich)|dabei\ kann\ ich\ nicht|ich\ (?:kann|darf|möchte|muss)\b.{0,60}\b(?:nicht|keine|ablehnen)|(?:zu|über)\ [\w\ -]{1,60}\ (?:darf|kann|möchte)\ ich\ (?:keine|nicht|nichts)
    |no\ (?:me\ está\ permitido|puedo\ (?:ayudar|responder|contestar|hablar|comentar|atender|compartir)|estoy\ autorizad)|prefiero\ no|debo\ (?:rechazar|negarme)|me\ es\ imposible|esta\ (?:pregunta|solicitud|petición)\ (?:supera|excede|va\ más\ allá))""",
    re.I | re.X | re.S,
)
# Openings of sentences that only send the reader elsewhere.
REFERRAL = re.compile(r"\W*(?:please|kindly|try|contact|ask|consult|perhaps|you (?:may|could|can|might)|if you|feel free|let me know|is there anything|thank you|thanks|bitte|wenden sie|veuillez|merci de|adressez|n'hésitez|consulte|pregunte|por favor|diríjase|gracias)\b", re.I)
SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n+")
ROW = re.compile(r"^\s*\|.*$", re.M)
QUOTE = re.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»")
CODE = re.compile(r"```.*?(?:```|\Z)", re.S)
NOTHING = (0, None, 0, 0, None, 0, None, None, None, None)
HEADS = (1, 2, 4, 8, 16, 32)  # characters of the beginnings by which neighbours are looked for
JSON_KEY = re.compile(r'"[^"\\]+"\s*:')
# Words of short lead-ins before a repeated message.
LEAD_IN = frozenset("sure certainly of course ok okay yes well you asked question your the query request was is message prompt q a re hi hello so here it answer reply bien sûr voici vous avez demandé votre claro por supuesto pregunta preguntó usted natürlich gerne frage ihre sie fragten lautet gefragt haben great good thanks for asking absolutely to repeat".split())

def visible(answer: str) -> str:
    """The part of an answer that a reader sees: no reasoning, tags or invisible characters."""
    if "<" in answer or "&" in answer:
        answer = TAG.sub(" ", THINK.sub(" ", answer))
    return INVISIBLE.sub(" ", answer).strip()


def is_empty(shown: str) -> bool:
    if len(shown) > 40:
        return not WORD.search(shown)
    bare = "".join(WORD.findall(shown)).lower()
    return not bare or bare in PLACEHOLDERS


def is_refusal(shown: str) -> bool:
    """Sentences of refusal and nothing else of substance: short referrals elsewhere are nothing."""
    shown = shown.replace("’", "'").replace("\u00a0", " ")
    for s in SENTENCE.split(shown):
        if not REFUSAL.search(s):
            size = len(WORD.findall(s))
            if size > 3 and not (size <= 14 and REFERRAL.match(s)):
                return False
    return bool(REFUSAL.search(shown))


def is_copy(message: str, shown: str) -> bool:
    """The answer repeats the message and adds at most a short lead-in."""
    low = shown.lower()
    asked = WORD.findall(message.lower())
    if len(asked) < 2:
        return bool(asked) and asked == WORD.findall(low)
    distinct = set(asked)
    if sum(w not in low for w in distinct) > 0.15 * len(asked):
        return _same_letters(asked, low)
    said = WORD.findall(low)
    if len(said) < 2 or len(distinct.difference(said)) > 0.15 * len(asked):
        return _same_letters(asked, low)
    spare, extra = Counter(asked), []
    rounds = max(1, round(len(said) / len(asked)))
    for w in spare:
        spare[w] *= rounds
    for w in said:
        if spare[w]:
            spare[w] -= 1
        else:
            extra.append(w)
    covered = len(said) - len(extra)
    if covered < 0.85 * len(asked) * rounds:
        return _same_letters(asked, low)
    return len(extra) <= 4 and (len(extra) <= 0.15 * len(asked) or all(w in LEAD_IN for w in extra))


def _same_letters(asked: list[str], low: str) -> bool:
    """Whether both hold the same letters and digits, however they are spaced."""
    joined, first = "".join(asked), WORD.search(low)
    return len(joined) > 8 and bool(first) and joined.startswith(first.group()) and "".join(WORD.findall(low)) == joined


def prose(shown: str) -> str:
    """The part of an answer whose language counts: no code, table rows, quotes or JSON keys."""
    if shown[:1] in "{[":
        return JSON_KEY.sub(" ", shown)
    if "```" in shown:
        shown = CODE.sub(" ", shown)
    if "|" in shown:
        shown = ROW.sub(" ", shown)
    return QUOTE.sub(" ", shown)


def other_language(asked: list[str], shown: list[str]) -> list[bool]:
    """Whether the language of each answer is neither its message's nor one the message asks for."""
    spoken, wanted = language.detect_all([prose(s) for s in shown]), language.detect_all(asked)
    return [bool(s and w and s != w and s not in language.requested(m)) for s, w, m in zip(spoken, wanted, asked, strict=True)]


JUDGED = "defect_type string, text long, source array<string>, chars int, bytes int, head array<long>, which int, grams array<long>, digits boolean, item boolean, style string"


def evidence(df: DataFrame, key: str, message: str, answer: str, sources: list[Column] | None = None) -> DataFrame:
    """(key, defect_type, rule): every rule that makes a pair defective.

    ``sources`` name what may cut answers (a client, a model); each has length limits of its own.
    Rules of ``truncated``: ``structure`` (an open code block, JSON value or table row), ``limit`` (an unfinished
    ending at a length where a source has far more answers than at the lengths around it), ``neighbour`` (a proper
    beginning of an answer next to it in text order), ``frame`` (the same beginning, names, numbers and content words
    masked, goes on in other answers) and ``ending`` (its last words go on in all texts).  Rules of the other defects
    have the defect's name.

    A repeated (key, message, answer) counts once.  A null answer is empty; a null message can make
    an answer neither a copy nor of another language.  Rows with a null key have no result.
    """
    named = F.array_compact(F.array(*(F.concat(F.lit(f"{i}:"), c.cast("string")) for i, c in enumerate(sources or [F.lit("")]))))
    rows = df.select(F.col(key).alias("key"), F.col(message).alias("message"), F.col(answer).alias("answer"), named.alias("source")).filter("key is not null")
    pairs = keep(rows.distinct().withColumn("mark", F.xxhash64("message", "answer")).withColumns({"text": F.xxhash64("answer"), "chars": F.length("answer"), "bytes": F.octet_length("answer")}))
    kind = df.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, cores = [], []
            shown, asked = [visible(t or "") for t in pdf["answer"]], [t or "" for t in pdf["message"]]
            for k, mark, text, source, q, raw, said, other in zip(pdf["key"], pdf["mark"], pdf["text"], pdf["source"], asked, pdf["answer"], shown, other_language(asked, shown), strict=True):
                if is_empty(said):
                    out.append((k, mark, "empty_answer", *NOTHING))
                    continue
                kinds = []
                copied = bool(q.strip()) and is_copy(q, said)
                if copied:
                    kinds.append("copies_question")
                elif is_refusal(said):
                    kinds.append("refusal")
                if other and q.strip():
                    kinds.append("other_language")
                ends = endings.endings(said) if not copied else []
                if ends and ends[0].state == "cut":
                    kinds.append("truncated")
                out.extend((k, mark, defect, *NOTHING) for defect in kinds)
                if ends and ends[0].state == "unsure":
                    facts = (k, mark, None, text, source, len(raw), len(raw.encode("utf-8", "replace")), _heads(raw)[-1:])
                    cores.extend((facts, end, which) for which, end in enumerate(ends))
            for (facts, end, which), (grams, digits) in zip(cores, endings.last_grams([c[1].core for c in cores]), strict=True):
                out.append((*facts, which, grams, digits, end.item, end.style))
            yield pd.DataFrame(out, columns=["key", "mark", *(c.split()[0] for c in JUDGED.split(", "))])

    judged = keep(pairs.select("key", "mark", "text", "message", "answer", "source").mapInPandas(judge, f"key {kind}, mark long, {JUDGED}"))
    unsure = judged.filter("defect_type is null")
    ids = ["key", "mark"]
    ended = endings.decide(unsure.select(*ids, "which", "grams", "digits", "item", "style"), endings.evidence(pairs, "answer", unsure), [*ids, "which"])
    ended = ended.groupBy(*ids).agg(F.bool_or("cut").alias("cut"), F.bool_or(F.col("cut") & F.col("goes_on")).alias("goes_on"))

    def sized(rows: DataFrame, *columns: str) -> DataFrame:
        """(columns, source, length) for each source and unit, the source named with its unit."""
        units = F.array(*(F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("chars", "bytes")))
        return rows.select(*columns, "s", F.explode(units).alias("u")).select(*columns, F.concat_ws("\t", "u.unit", "s").alias("source"), "u.length")

    def by_source(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.select(*columns, "chars", "bytes", F.explode("source").alias("s")).filter("chars > 0")

    torn = unsure.filter("which = 0 and style <> 'short'")
    limits = significant_lengths(*(sized(by_source(rows, "text").distinct()) for rows in (pairs, torn)))  # copies are one text
    lengths = sized(by_source(torn, *ids), *ids)
    at_limit = lengths.join(limits, ["source", "length"], "left_semi").select(*ids).distinct()
    rules = (
        ended.filter("goes_on").select(*ids, F.lit("frame").alias("rule"))
        .unionByName(ended.filter("cut").select(*ids, F.lit("ending").alias("rule")))
        .unionByName(at_limit.withColumn("rule", F.lit("limit")))
        .unionByName(shortened_versions(pairs, unsure.filter("which = 0")).withColumn("rule", F.lit("neighbour")))
    )
    by_rule = judged.filter("defect_type is not null").select("key", "defect_type", F.when(F.col("defect_type") == "truncated", "structure").otherwise(F.col("defect_type")).alias("rule"))
    return by_rule.unionByName(rules.select("key", F.lit("truncated").alias("defect_type"), "rule")).distinct()


def defects(df: DataFrame, key: str, message: str, answer: str, sources: list[Column] | None = None) -> DataFrame:
    """(key, defect_type), one row per pair and defect: empty_answer, truncated, refusal, copies_question, other_language; see :func:`evidence`."""
    return evidence(df, key, message, answer, sources).select("key", "defect_type").distinct()


def _heads(text: str) -> list[int]:
    """Hashes of the beginnings of a text of 1, 2, 4, ... characters that it has."""
    return [zlib.crc32(text[:n].encode("utf-8", "replace")) for n in HEADS if n <= len(text)]


def _stops_inside(short: str, few: bool, text: str) -> bool:
    """Whether ``short`` is a proper beginning of ``text`` and stops inside a sentence of it; of few words: inside a word."""
    if not text.startswith(short) or len(text) == len(short):
        return False
    after = text[len(short) : len(short) + 2]
    return after[0].isalpha() if few else after[0].isalnum() or (after[0] in " \u00a0" and after[1:].isalnum() and not after[1:].isupper())


def shortened_versions(pairs: DataFrame, unsure: DataFrame | None = None) -> DataFrame:
    """(key, mark) of the answers that are a proper beginning of their next neighbour in text order, and stop inside its sentence.

    pairs: (key, mark, answer); unsure: (key, mark, text, head, style) of the answers that may be shortened ones,
    with text a hash of the answer that ``pairs`` has too; without it every answer may be.  Copies are one text.
    Only answers that begin like an unsure one can be its neighbour, so only those are ordered, by ranges;
    each task compares neighbours and hands on its first and last answer, so that the few pairs across ranges
    are compared too.  Answers of any length take part; one of a few words must stop inside a word of its neighbour.
    """
    texts = (pairs if "text" in pairs.columns else pairs.withColumns({"text": F.xxhash64("answer"), "chars": F.length("answer"), "bytes": F.octet_length("answer")})).filter(F.length("answer") > 0)
    if unsure is None:
        unsure = texts.select("key", "mark", "text")
        near = texts.select("text", "answer").dropDuplicates(["text"]).withColumn("few", F.lit(False))
    else:
        shared = pairs.sparkSession.sparkContext.broadcast(endings.hash_filter(unsure, "head"))

        @F.pandas_udf(BooleanType())
        def begins(answers: pd.Series) -> pd.Series:
            heads = [_heads(t) for t in answers]
            size = np.array([len(h) for h in heads], np.int64)
            hit = np.concatenate(([0], np.cumsum(endings.passes(shared.value, np.fromiter(chain.from_iterable(heads), np.uint64)))))
            return pd.Series(hit[np.cumsum(size)] > hit[np.cumsum(size) - size])

        few = unsure.groupBy("text").agg(F.bool_and(F.col("style") == "short").alias("few"))
        near = texts.select("text", "answer").filter(begins("answer")).dropDuplicates(["text"]).join(few, "text", "left")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = None
        for pdf in batches:
            out = []
            for text, answer, few in zip(pdf["text"], pdf["answer"], pdf["few"], strict=True):
                if last and last[2] is not None and _stops_inside(last[1], last[2], answer):
                    out.append((last[0], None, None, None))
                first, last = first or answer, (text, answer, few)
            if out:
                yield pd.DataFrame(out, columns=["text", "few", "first", "last"], dtype=object)
        if last:
            yield pd.DataFrame([(last[0], last[2], first, last[1])], columns=["text", "few", "first", "last"], dtype=object)

    @F.pandas_udf(BooleanType())
    def crosses(short: pd.Series, few: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([f is not None and bool(t) and _stops_inside(s, bool(f), t) for s, f, t in zip(short, few, text, strict=True)])

    ordered = near.repartitionByRange("answer").sortWithinPartitions("answer")
    found = keep(ordered.mapInPandas(compare, "text long, few boolean, first string, last string"))
    edges = found.filter("first is not null").withColumn("next", F.lead("first").over(Window.orderBy("first")))  # a row a range
    short = found.filter("first is null").select("text").unionByName(edges.filter(crosses("last", "few", "next")).select("text"))
    return unsure.join(short, "text", "left_semi").select("key", "mark")
