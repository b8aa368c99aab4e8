"""Subject areas of documents: averaged word and subword embeddings with independent logistic outputs.

The markup of a page is stripped to its prose, the prose is cut into sentences, and the vector of a
sentence is the mean of its words' vectors, a word's vector the mean of the rows of its hashed form
and hashed character runs.  One logistic output for each area reads that vector.

Training: a bounded sample of labelled documents is packed once on the executors; every round each
partition adds up the gradients of its sentences, one executor sums them and the driver takes one Adam step.
After FIRST rounds with the documents' labels the sentences of the sample are labelled anew by the
model itself, so that sentences about nothing, or about a second subject, no longer carry their
document's label.  Scoring: since the outputs are linear in the mean, a word's contribution is
computed once for each distinct word; every sentence of every document is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm import words as W
from lodestack.session import cut

BUCKETS, DIM = 1 << 15, 12
RUNS = (3, 4, 5)  # lengths of the character runs
FIRST, SECOND, RATE = 16, 8, 0.3
SAMPLE = 6000  # labelled documents at most
PARTS = 3  # partitions of the sample
PLAIN, SURE = 0.4, 0.85  # least probability of a sentence's subject with and without a label of its document when labelled anew
TREATS = 0.5  # least probability of a subject that a sentence treats
SHARE = 0.25  # of the sentences that treat any subject
KNOWN = 400_000  # distinct words a task remembers

COMMENT = re.compile(r"<!--.*?-->|<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>|<(math|gallery|nowiki|blockquote|pre|code)\b[^<>]*>.*?</\1>", re.S | re.I)
BRACES = re.compile(r"\{\{|\}\}")
TABLE = re.compile(r"^[ \t:]*\{\|.*?^[ \t]*\|\}", re.S | re.M)
NAMESPACE = re.compile(r"\[\[[ \t]*[A-Za-zÀ-ÿ_-]+[ \t]*:[^\[\]]*\]\]")
LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]")
LINES = re.compile(r"^(?:=.*=|[|!].*|#.*|-{4,}|~{3,}.*)[ \t]*$", re.M)
INLINE = re.compile(r"</?[a-zA-Z][^<>]*>|'{2,}|\[[a-z]+://\S*|&nbsp;")


def without_templates(text: str) -> str:
    """The text with a blank for each outermost closed template, however deep they are nested; unclosed braces stay."""
    open_, closed = [], []
    for m in BRACES.finditer(text):
        if m.group() == "{{":
            open_.append(m.start())
        elif open_:
            start = open_.pop()
            while closed and closed[-1][0] > start:
                closed.pop()
            closed.append((start, m.end()))
    out, at = [], 0
    for start, end in closed:
        out += text[at:start], " "
        at = end
    return "".join(out) + text[at:]


def prose(text: str) -> str:
    """The text without comments, references, quotes, templates, tables, headings, categories and link targets."""
    if "<" in text:
        text = COMMENT.sub(" ", text)
    if "{{" in text:
        text = without_templates(text)
    if "{|" in text:
        text = TABLE.sub("\n", text)
    if "[[" in text:
        text = LINK.sub(r"\1", NAMESPACE.sub("", text))
    return INLINE.sub("", LINES.sub("", text))


def sentences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
    """(word hash, sentence, text of each sentence, joined string) of a batch; words keep their place."""
    lowered = [prose(t).lower() for t in texts]
    joined = "\0".join(lowered)
    hashes, owner, starts = W.scan(lowered)
    cps = W.code_points(joined)
    stop = np.isin(cps, np.array([46, 33, 63, 0x3002], np.uint32))
    after = np.append(cps[1:], np.uint32(0))
    edge = (stop & ((after <= 32) | (after == 160))) | (cps == 10) | (cps == 0)
    number = np.cumsum(edge)[starts] if len(starts) else np.empty(0, np.int64)
    first = np.concatenate(([True], (number[1:] != number[:-1]) | (owner[1:] != owner[:-1]))) if len(starts) else np.empty(0, bool)
    return hashes, np.cumsum(first) - 1, owner[first], (joined, starts)


def _rows_of_words(text: str, starts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows (flat) and their number for distinct words: one for the word, one for each character run."""
    cps = W.code_points(text)
    word = W.is_word_char(np.append(cps, np.uint32(0)))
    stops = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    length = stops[np.searchsorted(stops, starts, side="right")] - starts if len(starts) else starts
    total = length + 2
    offset = np.concatenate(([0], np.cumsum(total)[:-1])) if len(total) else total
    chars = np.full(int(total.sum()), 1, np.uint64)
    inner = np.arange(int(length.sum())) - np.repeat(np.concatenate(([0], np.cumsum(length)[:-1])), length)
    chars[np.repeat(offset + 1, length) + inner] = cps[np.repeat(starts, length) + inner]
    word = np.repeat(np.arange(len(starts)), total)
    rows, owners = [(hashes % np.uint64(BUCKETS)).astype(np.int64)], [np.arange(len(starts))]
    for n in RUNS:
        grams, owner = W.shingles(chars, word, n)
        rows.append((grams % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner)
    flat, owner = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return flat[order], np.bincount(owner, minlength=len(starts))


def _mean(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    return np.add.reduceat(values, np.minimum(first, len(values) - 1), axis=0) / np.maximum(count, 1)[:, None]


class Model:
    def __init__(self, areas: list[str], embedding: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.areas, self.embedding, self.weights, self.bias = areas, embedding, weights, bias
        self._known: dict[int, int] = {}
        self._scores = np.empty((0, len(areas)), np.float32)

    def __getstate__(self):
        return self.areas, self.embedding, self.weights, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def word_scores(self, text: str, starts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into scores for every word, scores): contributions of words to the outputs."""
        values, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.fromiter((self._known.get(h, -1) for h in values.tolist()), np.int64, len(values))
        new = np.flatnonzero(place < 0)
        if len(new):
            if len(self._known) + len(new) > KNOWN:
                self._known, self._scores = {}, np.empty((0, len(self.areas)), np.float32)
                new = np.arange(len(values))
            rows, count = _rows_of_words(text, starts[first[new]], values[new])
            scores = (_mean(self.embedding[rows], count) @ self.weights).astype(np.float32)
            place[new] = len(self._scores) + np.arange(len(new))
            self._known.update(zip(values[new].tolist(), place[new].tolist(), strict=True))
            self._scores = np.concatenate((self._scores, scores))
        return place[back], self._scores

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities of the areas for each sentence, text of each sentence)."""
        hashes, sentence, owner, (joined, starts) = sentences(texts)
        if not len(hashes):
            return np.empty((0, len(self.areas))), owner
        index, scores = self.word_scores(joined, starts, hashes)
        logits = _mean(scores[index], np.bincount(sentence)) + self.bias
        return 1 / (1 + np.exp(-logits)), owner


def treated(probability: np.ndarray) -> np.ndarray:
    """Which areas each sentence treats."""
    return probability >= TREATS


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sentences of labelled documents as arrays: one row for each partition."""
    frames = [pdf for pdf in batches if len(pdf)]
    if not frames:
        return
    pdf = pd.concat(frames)
    hashes, sentence, owner, (joined, starts) = sentences(pdf["text"].tolist())
    if not len(hashes):
        return
    values, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    rows, count = _rows_of_words(joined, starts[first], values)
    target = np.array(pdf["target"].tolist(), np.float32)[owner]
    arrays = {"rows": rows.astype(np.int32), "count": count.astype(np.int32), "word": back.astype(np.int32), "length": np.bincount(sentence).astype(np.int32), "target": target}
    yield pd.DataFrame({name: [a.tobytes()] for name, a in arrays.items()})


PACKED = "rows binary, count binary, word binary, length binary, target binary"


def _gradients(packed: dict[str, bytes], model: Model, relabel: Model | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int]:
    """Summed gradients (embedding, weights, bias), loss and number of the sentences of one partition."""
    rows, count, word, length = (np.frombuffer(packed[k], np.int32) for k in ("rows", "count", "word", "length"))
    target = np.frombuffer(packed["target"], np.float32).reshape(len(length), -1)
    if relabel is not None:
        scores = _mean(relabel.embedding[rows], count) @ relabel.weights
        seen = 1 / (1 + np.exp(-(_mean(scores[word], length) + relabel.bias)))
        best = seen == seen.max(axis=1, keepdims=True)
        target = ((seen >= SURE) | (best & (seen >= PLAIN) & (target > 0))).astype(np.float32)
    vectors = _mean(model.embedding[rows], count)
    mean = _mean(vectors[word], length)
    p = 1 / (1 + np.exp(-(mean @ model.weights + model.bias)))
    error = (p - target).astype(np.float32)
    back = (error @ model.weights.T) / length[:, None]
    each = np.repeat(np.arange(len(length)), length)
    by_word = np.stack([np.bincount(word, weights=back[each, d], minlength=len(count)) for d in range(DIM)], 1) / count[:, None]
    owner = np.repeat(np.arange(len(count)), count)
    embedding = np.stack([np.bincount(rows, weights=by_word[owner, d], minlength=BUCKETS) for d in range(DIM)], 1)
    loss = -float((target * np.log(p + 1e-9) + (1 - target) * np.log(1 - p + 1e-9)).sum())
    return embedding.astype(np.float32), mean.T @ error, error.sum(0), loss, len(length)


SUMS = "e binary, w binary, b binary, loss double, n long"


def _summed(parts: pd.DataFrame) -> pd.DataFrame:
    """The sum of the partitions' gradients (at most PARTS rows), made on an executor."""
    total = {c: [sum(np.frombuffer(x, kind) for x in parts[c]).astype(kind).tobytes()] for c, kind in (("e", np.float32), ("w", np.float64), ("b", np.float64))}
    return pd.DataFrame(total | {"loss": [float(parts["loss"].sum())], "n": [int(parts["n"].sum())]})


class _Adam:
    def __init__(self, *parameters: np.ndarray):
        self.parameters, self.step = parameters, 0
        self.mean, self.square = ([np.zeros_like(p) for p in parameters] for _ in range(2))

    def update(self, gradients: list[np.ndarray]) -> None:
        self.step += 1
        for p, g, m, s in zip(self.parameters, gradients, self.mean, self.square, strict=True):
            m += 0.2 * (g - m)
            s += 0.02 * (g * g - s)
            p -= RATE * (m / (1 - 0.8**self.step)) / (np.sqrt(s / (1 - 0.98**self.step)) + 1e-9)


def initial(areas: list[str]) -> Model:
    random = np.random.default_rng(7)
    return Model(areas, (random.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32), (random.standard_normal((DIM, len(areas)))).astype(np.float32), np.full(len(areas), -1.9, np.float32))


def fit(labelled: DataFrame, areas: list[str]) -> Model:
    """A model from (text, target array<float>) rows; an empty table gives a model that finds no subject."""
    packed = cut(labelled.repartition(PARTS).mapInPandas(_pack, PACKED))
    model, old = initial(areas), None
    adam = _Adam(model.embedding, model.weights, model.bias)
    context = labelled.sparkSession.sparkContext
    for turn in range(FIRST + SECOND):
        if turn == FIRST:
            old = Model(areas, model.embedding.copy(), model.weights.copy(), model.bias.copy())
        shared = context.broadcast((model, old))

        def add(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            now, before = shared.value
            for pdf in batches:
                for row in pdf.to_dict("records"):
                    e, w, b, loss, n = _gradients(row, now, before)
                    yield pd.DataFrame({"one": [0], "e": [e.astype(np.float32).tobytes()], "w": [w.astype(np.float64).tobytes()], "b": [b.astype(np.float64).tobytes()], "loss": [loss], "n": [n]})

        sums = packed.mapInPandas(add, f"one int, {SUMS}").groupBy("one").applyInPandas(_summed, SUMS).collect()  # one row, or none
        shared.destroy()
        if not sums or not sums[0].n:
            model.bias[:] = -20
            break
        total = sums[0]
        adam.update(
            [
                np.frombuffer(total.e, np.float32).reshape(BUCKETS, DIM) / total.n,
                (np.frombuffer(total.w, np.float64).reshape(DIM, -1) / total.n).astype(np.float32),
                (np.frombuffer(total.b, np.float64) / total.n).astype(np.float32),
            ]
        )
    return model


def targets(docs: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, label: str, areas: list[str], sample: int = SAMPLE) -> DataFrame:
    """(text, target) of at most ``sample`` labelled documents; the target is the share of the labels for each area.

    Labels are compared in lower case; null and unknown ones and repeats of one label are left out.
    Which documents are in the sample depends on a hash of their key only.
    """
    votes = labels.select(F.col(label_key).alias("key"), F.lower(F.trim(label)).alias("area")).filter(F.col("area").isin(areas)).distinct()
    target = F.array(*(F.count_if(F.col("area") == a) / F.count("*") for a in areas)).cast("array<float>")
    chosen = votes.groupBy("key").agg(target.alias("target")).orderBy(F.xxhash64("key"), "key").limit(sample)
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null").join(F.broadcast(chosen), "key").select("text", "target")


def subjects(docs: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, label: str, areas: list[str], sample: int = SAMPLE) -> DataFrame:
    """(key, area, share): areas that at least SHARE of the sentences of a document with any subject treat.

    Null, empty and markup-only texts have no row.  Repeated rows count once.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(targets(docs, key, text, labels, label_key, label, areas, sample), areas))
    kind = docs.schema[key].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, end in W.slices(pdf["text"].tolist()):
                piece = pdf.iloc[at:end]
                probability, owner = model.value.score(piece["text"].tolist())
                if not len(owner):
                    continue
                hit = treated(probability)
                some = hit.any(axis=1)
                total = np.bincount(owner[some], minlength=len(piece))
                keys = piece["key"].to_numpy()
                for a, area in enumerate(areas):
                    share = np.bincount(owner[hit[:, a]], minlength=len(piece)) / np.maximum(total, 1)
                    found = np.flatnonzero(share >= SHARE - 1e-9)
                    if len(found):
                        yield pd.DataFrame({"key": keys[found], "area": area, "share": share[found]})

    scored = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("key is not null and text is not null").mapInPandas(score, f"key {kind}, area string, share double")
    return scored.groupBy("key", "area").agg(F.max("share").alias("share"))
