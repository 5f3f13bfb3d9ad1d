"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams that both have (blended over the lengths 1 to 3, presence
and not counts), over the root of the product of the texts' own numbers. Nyström landmarks replace the kernel matrix:
a text is described by its kernel values with the landmarks, whitened by the landmarks' own kernel matrix, and
one-versus-rest kernel ridge regression is fitted in that space. Scoring is two matrix products for each batch of texts:
presence by landmarks, then landmarks by languages.

The model is fitted on at most PER_LANGUAGE whole texts of each language (the least hashes of the id); the landmarks
are a part of them. Their n-grams are taken on the executors and only those are sent to the driver. Every text is
scored, whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import kernel

LENGTHS = (1, 2, 3)
PER_LANGUAGE, LANDMARKS, RIDGE = 300, 32, 1e-2
SHARP = 8.0  # of the soft maximum that turns regression outputs into a score
UNDETERMINED = "und"
_MULTIPLIER = np.uint32(0x9E3779B1)


def grams(text: str) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the n-grams of the lower-cased text, white space as one blank."""
    a = np.frombuffer(" ".join(["", *text.lower().split(), ""]).encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
    out, h = [], np.zeros(len(a), np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        if len(a) < n:
            break
        h = h[: len(a) - n + 1] * _MULTIPLIER + a[n - 1 :]
        h ^= h >> np.uint32(15)
        if n in LENGTHS:
            out.append(h * np.uint32(2 * n + 1))
    a = np.sort(np.concatenate(out))
    new = np.ones(len(a), bool)
    np.not_equal(a[1:], a[:-1], out=new[1:])
    return a[new]


class KernelModel:
    """Landmarks, their n-grams, and the weights of each language."""

    def __init__(self, sets: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.langs = sorted(set(langs))
        chosen = [i for lang in self.langs for i in [j for j, x in enumerate(langs) if x == lang][:landmarks]]
        self.vocabulary = np.unique(np.concatenate([sets[i] for i in chosen]))
        self.marks = np.zeros((len(self.vocabulary), len(chosen)), np.float32)
        for j, i in enumerate(chosen):
            self.marks[np.searchsorted(self.vocabulary, sets[i]), j] = 1 / np.sqrt(len(sets[i]))
        own = self.kernel([sets[i] for i in chosen]).astype(np.float64)
        values, vectors = np.linalg.eigh((own + own.T) / 2)
        keep = values > 1e-6 * values.max()
        white = vectors[:, keep] / np.sqrt(values[keep])
        x = self.kernel(sets).astype(np.float64) @ white
        y = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        mean = y.mean(0)
        w = np.linalg.solve(x.T @ x + ridge * len(x) / 100 * np.eye(x.shape[1]), x.T @ (y - mean))
        self.weights, self.bias = (white @ w).astype(np.float32), mean.astype(np.float32)

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Kernel values of texts (rows) with the landmarks."""
        out = np.empty((len(sets), self.marks.shape[1]), np.float32)
        for at in range(0, len(sets), 64):
            part = sets[at : at + 64]
            flat = np.concatenate(part)
            owner = np.repeat(np.arange(len(part)), [len(s) for s in part])
            place = np.minimum(np.searchsorted(self.vocabulary, flat), len(self.vocabulary) - 1)
            known = self.vocabulary[place] == flat
            presence = np.zeros((len(part), len(self.vocabulary)), np.float32)
            presence[owner[known], place[known]] = 1
            out[at : at + 64] = (presence @ self.marks) / np.sqrt([[len(s)] for s in part])
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Languages, scores, and the languages' own regression outputs: 1 for a typical text, -1 for one of another language."""
        out = self.kernel([grams(t) for t in texts]) @ self.weights + self.bias
        e = np.exp(SHARP * (out - out.max(1, keepdims=True)))
        return [self.langs[i] for i in out.argmax(1).tolist()], (1 / e.sum(1)).astype(float).tolist(), out.max(1).astype(float).tolist()


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text[:200]) or any(map(str.isalpha, text[200:]))


def _gram_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [grams(t).tobytes() for t in b.column("t").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("l"), b.column("h"), pa.array(sets, pa.binary())], names=["l", "h", "grams"])


def fit(examples: DataFrame, id_col: str, text_col: str, lang_col: str) -> KernelModel | None:
    """Of the labelled rows with a letter, at most PER_LANGUAGE of each language.

    Rows are chosen by hashes alone: counts give each language a bound that far more than PER_LANGUAGE hashes stay
    under, and the least of those few are ranked. Null languages and texts are no examples; rows that repeat an id have equal hashes and
    are ranked by their text's. Texts are as long as they are; a text's n-grams, not its length, go to the driver.
    """
    d = examples.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    d = d.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"), F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.xxhash64(text_col).alias("g"))
    counts = {r.l: r.n for r in d.groupBy("l").agg(F.count("*").alias("n")).collect()}  # one row a language, as the model has a column for each
    if not counts:
        return None

    def of(values: dict[str, Column]) -> Column:
        return F.try_element_at(F.create_map(*[x for lang, v in values.items() for x in (F.lit(lang), v)]), F.col("l"))

    near = d.select("l", "h", "g").filter((F.col("h").cast("double") / 2.0**64 + 0.5) < of({lang: F.lit(4.0 * PER_LANGUAGE / n) for lang, n in counts.items()}))
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h", "g"))
    last = {r.l: (r.last.h, r.last.g) for r in near.withColumn("r", rank).filter(F.col("r") <= PER_LANGUAGE).groupBy("l").agg(F.max(F.struct("h", "g")).alias("last")).collect()}
    upto = of({lang: F.struct(F.lit(h).cast("long").alias("h"), F.lit(g).cast("long").alias("g")) for lang, (h, g) in last.items()}) if last else F.lit(None)
    chosen = kernel(d.filter(F.struct("h", "g") <= upto).select("l", "h", "t"), _gram_sets, "l string, h long, grams binary") if last else d.limit(0).select("l", "h", F.lit(b"").alias("grams"))
    per, rows = {}, []
    for r in chosen.collect():  # PER_LANGUAGE sets of n-grams a language, and those of rows that repeat the last one
        per.setdefault(r.l, []).append((r.h, r.grams))
    for lang in sorted(per):
        rows += [(lang, np.frombuffer(g, np.uint32)) for _, g in sorted(per[lang])[:PER_LANGUAGE]]
    return KernelModel([g for _, g in rows], [lang for lang, _ in rows]) if rows else None


def identify(docs: DataFrame, model: KernelModel | None, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score", output_col: str | None = None) -> DataFrame:
    """docs with the predicted language and a score in 0 to 1; output_col: also the language's own regression output (-1 for `und`).

    A text that is null or has no letter is `und` with score 0, and so is every text without a model (no labelled rows).
    Very long texts are scored whole, like others. Repeated rows are scored alike; an empty table gives an empty result.
    Added columns replace those of the same name.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)
    added = [lang_col, score_col, *([output_col] if output_col else [])]
    kept = [(i, c) for i, c in enumerate(docs.columns) if c not in added]
    names = [c for _, c in kept] + added

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            texts = b.column(place).to_pylist()
            real = [i for i, t in enumerate(texts) if m is not None and t and has_letter(t)]
            langs, scores, outputs = [UNDETERMINED] * len(texts), [0.0] * len(texts), [-1.0] * len(texts)
            for at in range(0, len(real), 64):
                part = real[at : at + 64]
                for i, lang, s, o in zip(part, *m.predict([texts[i] for i in part]), strict=True):
                    langs[i], scores[i], outputs[i] = lang, s, o
            new = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(outputs, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i, _ in kept), *new[: len(added)]], names=names)

    fields = [docs.schema.fields[i] for i, _ in kept]
    schema = type(docs.schema)(fields).add(lang_col, "string").add(score_col, "double")
    return kernel(docs, run, schema.add(output_col, "double") if output_col else schema)
